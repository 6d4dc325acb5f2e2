"""Best-fit packing of documents into fixed-length sequences after Martello-Toth dominance reduction.

A document's ids and its end id make pieces of at most CAPACITY tokens; only longer documents are cut.  Which
pieces share a sequence depends on their lengths alone, so the number of pieces of each length, a table of at
most CAPACITY rows at any size of the input, is all that the packer needs:

1. Reduction.  From the longest length down, small sets that dominate every other set a piece could be in are
   fixed for good: a piece alone if nothing fits beside it; a pair that fills the sequence, or whose second
   piece is at least as long as any two that fit; a triple whose members are at least as long, one by one, as
   those of any other pair that fits, where no three more fit.
2. The rest is packed best-fit decreasing, a whole length at a time.

Pieces of a length are then numbered across the cluster, and each number maps to its sequence and offset.

Defined results: a null or blank text is its end id alone; rows that repeat a doc_id are packed each; an
empty table has no sequence; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .encoding import encoder

CAPACITY = 2048
#: Pieces that one task numbers.
NUMBERED_TOGETHER = 1_000

#: A pattern (lengths in order) and how many sequences have it.
Pattern = tuple[tuple[int, ...], int]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, end = encoder(vocabulary).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).cast(pa.large_binary()).to_pylist()), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        rows.append((doc_id, k, a // 4, len(own) // 4, zlib.crc32(own)))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Left:
    """Lengths still to be packed, with their numbers."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, n: int) -> None:
        self.n[size] -= n
        if not self.n[size]:
            del self.n[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def largest(self, most: int, used: dict[int, int]) -> int:
        """The largest length of at most most that is left besides those used; 0 if there is none."""
        k = bisect_left(self.sizes, most + 1) - 1
        while k >= 0 and self.n[self.sizes[k]] <= used.get(self.sizes[k], 0):
            k -= 1
        return self.sizes[k] if k >= 0 else 0

    def least(self, many: int, used: dict[int, int]) -> int | None:
        """The sum of the smallest pieces besides those used; None if fewer are left."""
        total = 0
        for size in self.sizes:
            n = min(many, self.n[size] - used.get(size, 0))
            total, many = total + n * size, many - n
            if not many:
                return total
        return None


def _dominating(left: _Left, size: int, capacity: int) -> tuple[int, ...] | None:
    """The set that dominates all others that hold a piece of this length, if one of up to three is found."""
    room, own = capacity - size, {size: 1}
    one = left.largest(room, own)
    if not one:
        return (size,)
    if one == room:
        return (size, one)
    two = left.least(2, own)
    if two is None or two > room:
        return (size, one)
    three = left.least(3, own)
    if three is not None and three <= room:
        return None
    # At most two more pieces fit: the best pair by its sum, and the largest second piece of any pair.
    best = second = 0
    for a in left.sizes:
        if a > room:
            break
        if left.n[a] <= own.get(a, 0):
            continue
        b = left.largest(min(a, room - a), {**own, a: own.get(a, 0) + 1})
        if b:
            best, second = max(best, a + b), max(second, b)
    if one >= best:
        return (size, one)
    b = left.largest(room - one, {**own, one: own.get(one, 0) + 1})
    return (size, one, b) if b and b >= second else None


def reduce_dominated(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed patterns, and the lengths that are left."""
    left, fixed = _Left(counts), []
    moved = True
    while moved:
        moved = False
        for size in sorted(left.n, reverse=True):
            while size in left.n and (found := _dominating(left, size, capacity)):
                many = min(left.n[x] // found.count(x) for x in set(found))
                for x in found:
                    left.take(x, many)
                fixed.append((found, many))
                moved = True
    return fixed, left.n


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing over lengths with numbers: sequences of one pattern are kept as one group."""
    rooms: list[int] = []
    open_by_room: dict[int, list[Pattern]] = {}

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_by_room:
            insort(rooms, room)
            open_by_room[room] = []
        open_by_room[room].append((pattern, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                if whole := n // each:
                    put(capacity - each * size, (size,) * each, whole)
                if rest := n % each:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[k]
            pattern, many = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room], rooms[k]
            each = room // size
            whole = min(many, n // each)
            if whole:
                put(room - each * size, pattern + (size,) * each, whole)
            n -= whole * each
            many -= whole
            if many and n:
                put(room - n * size, pattern + (size,) * n, 1)
                many, n = many - 1, 0
            if many:
                put(room, pattern, many)
    return [x for room in rooms for x in open_by_room[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """By length, runs of numbers: first number, first sequence, pieces of the length in a sequence, and their offsets."""
    next_number: dict[int, int] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    offsets: list[int] = []
    sequence = 0
    for pattern, many in patterns:
        at, own = 0, {}
        for size in pattern:
            own.setdefault(size, []).append(at)
            at += size
        for size, where in own.items():
            first = next_number.get(size, 0)
            runs.append((size, first, sequence, len(where), len(offsets)))
            offsets += where
            next_number[size] = first + many * len(where)
        sequence += many
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return {"key": table[:, 0] << 48 | table[:, 1], "runs": table, "offsets": np.array(offsets, np.int64)}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a number of each row; reads cut more than once, so it should be a written table."""
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row a length
    places = _places(plan(counts, capacity))
    salts = max(counts.values(), default=0) // NUMBERED_TOGETHER + 1
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_salt").orderBy("row")
    numbered = salted.withColumn("_own", F.row_number().over(own)).join(firsts, ["length", "_salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = numbered.select(*names, (F.col("_first") + F.col("_own") - 1).alias("number"))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            run = places["runs"][np.searchsorted(places["key"], length << 48 | number, side="right") - 1] if batch.num_rows else np.zeros((0, 5), np.int64)
            nth = number - run[:, 1]
            sequence = run[:, 2] + nth // np.maximum(run[:, 3], 1)
            offset = places["offsets"][run[:, 4] + nth % np.maximum(run[:, 3], 1)] if batch.num_rows else nth
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def digest(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    # The rows' numbers deal equal pieces evenly too.
    return pack(written(pieces(docs, vocabulary, end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity)
