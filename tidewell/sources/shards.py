"""Token shards: headerless little-endian unsigned 16-bit ids, as a Spark data source.

Filters on offset are pushed into the scan, which then reads the bytes of what they ask for.

``spark.read.format("token_shard").load(storage.qualified(spark, path))`` gives (offset, token), cut by byte ranges; writing takes rows
(offset, token) sorted within partitions and leaves a file a task, named so that their order is the order of
first offsets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .storage import filesystem, publish

#: Bytes that a read task takes.
RANGE = 8 << 20
#: Stretches of offsets that lie no further apart than so many tokens are read as one.
NEAR = 256
#: The file that names the generation of shards that holds.
CURRENT = "_CURRENT"


@dataclass
class Piece:
    """size bytes from at of a file, whose first token has this offset."""

    name: str
    at: int
    size: int
    offset: int


@dataclass
class Range(InputPartition):
    pieces: list[Piece]


def shard_files(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the shards that hold, in the order of their offsets."""
    from pyarrow import fs as pfs

    fs, folder = filesystem(path)
    generation = ""
    if fs.get_file_info(f"{folder}/{CURRENT}").is_file:
        with fs.open_input_file(f"{folder}/{CURRENT}") as file:
            generation = file.read().decode()
    found = fs.get_file_info(pfs.FileSelector(folder))
    return sorted((f.path, f.size) for f in found if f.path.endswith(f"{generation}.bin"))


def total_tokens(path: str) -> int:
    """Tokens of the shards at a qualified path, by the files' sizes."""
    return sum(size for _, size in shard_files(path)) // 2


def _stretches(offsets: list[int]) -> list[tuple[int, int]]:
    """Stretches [from, to) that hold sorted offsets, near ones together."""
    out: list[tuple[int, int]] = []
    for o in offsets:
        if out and o - out[-1][1] <= NEAR:
            out[-1] = (out[-1][0], max(out[-1][1], o + 1))
        else:
            out.append((o, o + 1))
    return out


class Reader(DataSourceReader):
    """Comparisons of offset with constants are pushed down, so a window reads its own bytes."""

    def __init__(self, path: str):
        self.path = path
        self.low, self.high = 0, None
        self.wanted: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("offset",):
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe, In)):
                own = set(f.value if isinstance(f, In) else [f.value]) - {None}
                self.wanted = own if self.wanted is None else self.wanted & own
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            elif not isinstance(f, IsNotNull):  # an offset is never null
                yield f

    def holds(self, offset: int) -> bool:
        return offset >= self.low and (self.high is None or offset < self.high)

    def partitions(self) -> list[Range]:
        files, before, total = [], 0, 0
        for name, size in shard_files(self.path):
            files.append((name, before, size // 2))
            before += size // 2
        total = before if self.high is None else min(before, self.high)
        if self.wanted is None:
            asked = [(self.low, total)] if self.low < total else []
        else:
            asked = _stretches(sorted(o for o in self.wanted if self.holds(o) and o < total))
        pieces, k = [], 0
        for low, high in asked:
            while k < len(files) and files[k][1] + files[k][2] <= low:
                k += 1
            for name, first, n in files[k:]:
                if first >= high:
                    break
                a, b = max(low, first), min(high, first + n)
                pieces += [Piece(name, 2 * (at - first), 2 * (min(at + RANGE // 2, b) - at), at) for at in range(a, b, RANGE // 2)]
        out, size = [], RANGE
        for p in pieces:
            if size + p.size > RANGE:
                out.append(Range([]))
                size = 0
            out[-1].pieces.append(p)
            size += p.size
        return out or [Range([])]  # no partition at all would be read as one without bounds

    def read(self, part: Range) -> Iterator:
        import numpy as np
        import pyarrow as pa

        fs, _ = filesystem(self.path)
        wanted = None if self.wanted is None else np.array(sorted(self.wanted), np.int64)
        for p in part.pieces:
            with fs.open_input_file(p.name) as file:
                file.seek(p.at)
                ids = np.frombuffer(file.read(p.size), "<u2")
            for at in range(0, len(ids), 1 << 16):
                own = ids[at : at + (1 << 16)].astype(np.int32)
                offsets = np.arange(len(own), dtype=np.int64) + p.offset + at
                if wanted is not None:
                    kept = np.isin(offsets, wanted)
                    own, offsets = own[kept], offsets[kept]
                yield pa.RecordBatch.from_arrays([pa.array(offsets), pa.array(own)], ["offset", "token"])


@dataclass
class Written(WriterCommitMessage):
    own: str | None
    first: int


class Writer(DataSourceArrowWriter):
    """Each task writes a file under a name of its own; the commit of the whole job gives them their names, in a folder
    that must hold no shard yet unless the job overwrites."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator) -> Written:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        first = out = None
        own = f"{folder}/_{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = batch.column("token").to_numpy(zero_copy_only=False)
            if tokens.min() < 0 or tokens.max() > 65535:
                raise ValueError("token id beyond 16 bits")
            if out is None:
                first, out = batch.column("offset")[0].as_py(), fs.open_output_stream(own)
            out.write(tokens.astype("<u2").tobytes())
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(own, first)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs as pfs

        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        old = [f.path for f in fs.get_file_info(pfs.FileSelector(folder)) if f.path.endswith(".bin")]
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} holds shards already")
        # The new generation is whole before CURRENT names it, and the old one goes only then.
        generation = f"-{uuid.uuid4().hex}"
        for m in messages:
            if m and m.own:
                publish(fs, m.own, f"{folder}/shard-{m.first:020d}{generation}.bin")
        with fs.open_output_stream(f"{folder}/_{generation}") as out:
            out.write(generation.encode())
        if fs.get_file_info(f"{folder}/{CURRENT}").is_file and fs.type_name != "local":
            fs.delete_file(f"{folder}/{CURRENT}")  # stores that do not replace a file by moving another there
        fs.move(f"{folder}/_{generation}", f"{folder}/{CURRENT}")
        for name in old:
            fs.delete_file(name)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            if m and m.own:
                fs.delete_file(m.own)


def _resolved(path: str) -> str:
    """The path with a scheme.  Python data sources are planned outside the driver's process, so a path without one is
    resolved beforehand, by qualified(); one that was not is local."""
    return path if ":" in path.split("/", 1)[0] else f"file:{path}"


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shard"

    def schema(self) -> str:
        return "offset long, token int"

    def reader(self, schema) -> Reader:
        return Reader(_resolved(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(_resolved(self.options["path"]), overwrite)


def register(spark: SparkSession) -> None:
    """Names the source in the session, and lets the session push filters into sources of this kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenShards)


def windows(spark: SparkSession, path: str, starts: DataFrame, length: int) -> DataFrame:
    """(i, start, x, y) of the windows at starts (i, start), read from the shards at a qualified path.

    Starts are one batch, whose size is a parameter; the offsets of its windows are pushed into the scan.
    """
    drawn = starts.select("i", "start").collect()
    offsets = sorted({o for r in drawn for o in range(r.start, r.start + length + 1)})
    rows = spark.read.format("token_shard").load(path).filter(F.col("offset").isin(offsets))
    placed = starts.select("i", "start", F.explode(F.sequence("start", F.col("start") + length)).alias("offset"))
    tokens = F.array_sort(F.collect_list(F.struct("offset", "token")))
    whole = F.broadcast(placed).join(rows, "offset").groupBy("i", "start").agg(F.transform(tokens, lambda t: t["token"]).cast("array<long>").alias("t"))
    return whole.select("i", "start", F.slice("t", 1, length).alias("x"), F.slice("t", 2, length).alias("y"))
