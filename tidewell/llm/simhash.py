"""SimHash near-duplicates: 64-bit fingerprints, pivot distance tables, connected components.

A link joins fingerprints that differ in at most two bits.  For each distinct fingerprint the Hamming
distances to 32 reference fingerprints (pivots) are computed once.  Linked fingerprints agree outside two of
six bit blocks, so they meet in one of fifteen cells, keyed by their other bits; there a pair is discarded
when some pivot distance differs by more than two (the triangle inequality), and what is left is verified by
its own distance.  Cells of more than HOT_CELL fingerprints are dealt again by pairs of two-bit blocks, which
leaves at most sixteen fingerprints in a cell, so no cell makes pairs without bound.  Each linked pair is
accepted in one cell alone.

Defined results: a null or blank text has no word and the fingerprint zero, linked like any other; equal
texts share a fingerprint; rows that repeat a doc_id are one document, which stays or goes as a whole; rows
without a doc_id have a fingerprint, count for no component_id and are never removed; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written
from .graph import components

SHINGLE = 3
SEED = 42
BITS = 64
DISTANCE = 2
PIVOTS = 32
#: Lowest bit and width of each block.
BLOCKS = ((0, 10), (10, 10), (20, 10), (30, 10), (40, 12), (52, 12))
HOT_CELL = 64


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        found = [fingerprint(x.as_py() or b"") for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), a row for each row of docs; fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints from a multiplicative rule."""
    return [_signed((k * 0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64)) for k in range(n)]


def _pivot_table(fp: str) -> list[Column]:
    """The distances to all pivots, eight to a long."""
    p = pivots()
    packed = []
    for at in range(0, len(p), 8):
        terms = [f"shiftleft(CAST(bit_count({fp} ^ {x}L) AS BIGINT), {8 * k})" if x != -(1 << 63) else "0L" for k, x in enumerate(p[at : at + 8])]
        packed.append(F.expr(" | ".join(terms)).alias(f"p{at // 8}"))
    return packed


def _near(a: str, b: str) -> str:
    """No pivot coordinate differs by more than DISTANCE."""
    return " AND ".join(f"abs((shiftright({a}.p{k // 8}, {8 * (k % 8)}) & 127) - (shiftright({b}.p{k // 8}, {8 * (k % 8)}) & 127)) <= {DISTANCE}" for k in range(PIVOTS))


def _deals(parts: list[int]) -> list[tuple[int, int, bool, bool]]:
    """Pairs of free parts (masks), and whether a pair that differs in the first or second alone is accepted there."""
    n = len(parts)
    home = {k: (k, k + 1) if k + 1 < n else (0, k) for k in range(n)}
    return [(parts[i], parts[j], home[i] == (i, j), home[j] == (i, j)) for i, j in combinations(range(n), 2)]


def _mask(low: int, width: int) -> int:
    return ((1 << width) - 1) << low


def _cells(nodes: DataFrame, deals: list[tuple[int, int, bool, bool]]) -> Column:
    rows = [F.struct(F.lit(t).alias("t"), F.expr(f"fp & {_signed(~(a | b) % (1 << 64))}L").alias("key")) for t, (a, b, _, _) in enumerate(deals)]
    return F.explode(F.array(*rows))


def _link(cells: DataFrame) -> DataFrame:
    """Verified links of fingerprints that share (t, key); cells has fp, the pivot table, a, b, only_a and only_b."""
    x, y = cells.alias("x"), cells.alias("y")
    differ = "(x.fp ^ y.fp)"
    held = f"({differ} & x.a != 0 OR x.only_b) AND ({differ} & x.b != 0 OR x.only_a)"
    on = f"x.t = y.t AND x.key = y.key AND x.fp < y.fp AND {_near('x', 'y')} AND bit_count({differ}) <= {DISTANCE} AND {held}"
    return x.join(y, F.expr(on)).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v"))


def _with_deal(df: DataFrame, deals: list[tuple[int, int, bool, bool]]) -> DataFrame:
    of = lambda k, kind: F.element_at(F.array(*[F.lit(_signed(x[k]) if kind == "long" else x[k]).cast(kind) for x in deals]), F.col("t") + 1)
    return df.select("*", of(0, "long").alias("a"), of(1, "long").alias("b"), of(2, "boolean").alias("only_a"), of(3, "boolean").alias("only_b"))


def links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) of distinct fingerprints in nodes (fp) that differ in one or two bits."""
    first = _deals([_mask(*x) for x in BLOCKS])
    dealt = nodes.select("fp", _cells(nodes, first).alias("c")).select("c.t", "c.key", "fp")
    shared = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(dealt.join(shared, ["t", "key"]), "cells")
    table = _pivot_table("fp")
    cool = _link(_with_deal(met.filter(f"n <= {HOT_CELL}").select("t", "key", "fp", *table), first))
    # The free bits of a hot cell are dealt again, two bits to a part; this table of the deals has a fixed size.
    again = []
    for t, (a, b, _, _) in enumerate(first):
        parts = [3 << k for k in range(0, BITS, 2) if (a | b) >> k & 1]
        again += [(t, len(again) + k, _signed(~(i | j) % (1 << 64)), _signed(i), _signed(j), p, q) for k, (i, j, p, q) in enumerate(_deals(parts))]
    deals = nodes.sparkSession.createDataFrame(again, "t int, t2 int, keep long, a2 long, b2 long, only_a2 boolean, only_b2 boolean")
    hot = met.filter(f"n > {HOT_CELL}").select("t", "fp").join(F.broadcast(deals), "t").withColumn("key", F.expr("fp & keep"))
    # The first deal's own rule still holds: each pair is accepted under one t.
    hot = _with_deal(hot, first)
    hot = hot.select("t2", "key", "fp", "a", "b", "only_a", "only_b", "a2", "b2", "only_a2", "only_b2", *table)
    x, y = hot.alias("x"), hot.alias("y")
    differ = "(x.fp ^ y.fp)"
    held = " AND ".join(f"({differ} & x.a{s} != 0 OR x.only_b{s}) AND ({differ} & x.b{s} != 0 OR x.only_a{s})" for s in ("", "2"))
    on = f"x.t2 = y.t2 AND x.key = y.key AND x.fp < y.fp AND {_near('x', 'y')} AND bit_count({differ}) <= {DISTANCE} AND {held}"
    hot = x.join(y, F.expr(on)).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v"))
    return cool.unionByName(hot)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    fps = written(fingerprints(docs), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    labels = written(components(links(nodes.select("fp"))), "labels")
    linked = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "least", "copies", F.coalesce("label", "fp").alias("label"))
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(linked.join(least, "label").select("fp", "copies", "component_id"), "components")
    return join_hot(fps, named, "fp", "copies", fps.count()).select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the documents that have a near-duplicate of a smaller doc_id in their group."""
    removed = near_duplicates(docs).filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(removed, "doc_id", "left_anti").select(*docs.columns)
