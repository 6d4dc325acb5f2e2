"""Whitened embeddings by principal components.

Entries become whole numbers, so counts and sums are exact; rows are centred as whole numbers (n times the row less the
sums) before they are divided and multiplied.  RowMatrix sums the products of the centred rows; the covariance, a
square of the dimensions, is decomposed on the driver, and the scaled components go to the tasks that whiten rows.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out; shorter vectors are as
long as the longest, their further entries zero; entries beyond a long's range stop at its ends; a deviation that no
long holds is null, and ``deviation_exact`` has it as text; a component without variance has null in ``whitened`` and
no part in ``identity_error``; rows that repeat a vec_id, and rows without one, count each; other columns are ignored;
an empty table, and one of empty vectors, gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
#: Dimensions at most: the driver holds squares of them.
MOST_DIMENSIONS = 8192
#: A component whose variance is a smaller share of the first one's has none.
LEAST_SHARE = 1e-12
LOW, HIGH = -(2**63), 2**63 - 1
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the rows whose vector has finite entries only, as doubles."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("v IS NOT NULL AND size(v) > 0")
    return v.filter("forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")


def whole(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT as longs, which stop at the ends of their range."""
    scaled = np.floor(SCALE * v)
    near = np.abs(scaled) < 2.0**62
    x = np.where(near, scaled, 0).astype(np.int64) + SHIFT
    return np.where(near, x, np.where(scaled > 0, HIGH, LOW))


def _matrix(column, dimensions: int) -> np.ndarray:
    """Rows of an Arrow column of lists, filled with zeros."""
    lists = column.to_pylist() if column.null_count else None
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if lists is None and (sizes == dimensions).all():
        return flat.reshape(-1, dimensions)
    out = np.zeros((len(sizes), dimensions))
    at = 0
    for k, size in enumerate(sizes):
        out[k, :size] = flat[at : at + size]
        at += size
    return out


def _spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums: longs where they hold every value, else Python's integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most + max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(z: np.ndarray) -> list[int]:
    """Exact sums of squares of rows."""
    if z.dtype == object:
        return [sum(int(a) * int(a) for a in row) for row in z]
    most = int(np.abs(z).max(initial=0))
    if most * most * z.shape[1] < 2**62:
        return (z * z).sum(axis=1).tolist()
    if most >> 24 < 2**24:  # halves of 24 bits, whose products fit
        high, low = z >> 24, z & 0xFFFFFF
        parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
        return [(a << 48) + (b << 25) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]
    return _squares(z.astype(object))


def sums(rows: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """How many rows there are, and the sum of each dimension."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, total = 0, [0] * dimensions
        for batch in batches:
            x = whole(_matrix(batch.column(0), dimensions))
            n += len(x)
            if len(x) and max(int(x.max()), -int(x.min())) < 2**62 // len(x):
                added = x.sum(axis=0).tolist()
            else:
                added = [sum(int(a) for a in column) for column in x.T]
            total = [a + b for a, b in zip(total, added, strict=True)]
        text = pa.array([str(t) for t in total])
        yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), text, pa.array([n] * dimensions, pa.int64())], ["dimension", "total", "n"])

    parts = rows.select("v").mapInArrow(run, "dimension int, total string, n long").withColumn("total", F.col("total").cast("decimal(38,0)"))
    found = parts.groupBy("dimension").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("dimension").collect()
    return found[0].n, [int(r.total) for r in found]


def covariance(rows: DataFrame, n: int, totals: list[int]) -> np.ndarray:
    """RowMatrix over exactly centred rows: its Gramian by n."""
    dimensions = len(totals)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            z = _spread(whole(_matrix(batch.column(0), dimensions)), n, totals).astype(np.float64) / n
            offsets = pa.array(np.arange(0, z.size + 1, dimensions), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], ["z"])

    centred = rows.select("v").mapInArrow(run, "z array<double>").select(array_to_vector("z").alias("z"))
    gramian = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "z"), numCols=dimensions).computeGramianMatrix()
    return gramian.toArray() / n


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact)."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    dimensions = rows.agg(F.max(F.size("v"))).first()[0]
    if not dimensions:
        return spark.createDataFrame([], SCHEMA)
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dimensions} dimensions; {MOST_DIMENSIONS} at most")
    n, totals = sums(rows, dimensions)
    v = covariance(rows, n, totals)
    values, axes = np.linalg.eigh(v)
    first = np.argsort(-values, kind="stable")[: min(components, dimensions)]
    values, axes = values[first], axes[:, first]
    has = values > max(values[0], 0) * LEAST_SHARE
    scale = np.where(has, 1 / np.sqrt(np.where(has, values, 1)), np.nan)
    sent = spark.sparkContext.broadcast(axes * scale)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            z = _spread(whole(_matrix(batch.column(1), dimensions)), n, totals)
            squares = _squares(z)
            w = z.astype(np.float64) / n @ sent.value
            offsets = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
            whitened = pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), from_pandas=True))
            fits = [s if s <= HIGH else None for s in squares]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fits, pa.int64()), pa.array([str(s) for s in squares]), whitened], ["vec_id", "deviation", "deviation_exact", "w"])

    made = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(run, "vec_id long, deviation long, deviation_exact string, w array<double>"), "whitened")
    error = identity_error(made, [k for k in range(len(has)) if has[k]])
    trace = float(np.trace(v))
    share = [float(e) / trace if trace > 0 else None for e in values]
    out = made.select("*", F.posexplode("w").alias("k", "whitened"))
    explained = F.element_at(F.array(*[F.lit(s).cast("double") for s in share]), F.col("k") + 1)
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact")


def identity_error(whitened: DataFrame, components: list[int]) -> float | None:
    """The largest absolute entry of the covariance of the rows' components less the identity, measured on the rows."""
    if not components:
        return None
    at = {k: F.col("w")[k] for k in components}
    means = whitened.agg(*[F.avg(at[k]).alias(f"m{k}") for k in components]).first()
    centred = {k: at[k] - F.lit(means[f"m{k}"]) for k in components}
    pairs = [(a, b) for a in components for b in components if a <= b]
    found = whitened.agg(*[F.avg(centred[a] * centred[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
