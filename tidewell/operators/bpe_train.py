"""The trainer of byte-pair encoding over any number of distinct pieces.

Pieces stay on the executors, in blocks of flat id arrays.  A round takes the most frequent pairs and cuts the pieces
wherever two neighbours are none of these; the driver gets the distinct stretches that are left, with their counts, and
learns from them by itself.  A pair that was not taken never gets more frequent, and what arises across a cut is no more
frequent than the pair that was cut, with larger ids.  So while the best pair comes before all that were not taken, the
merges are those of one merge after another over all pieces; then they are applied to the blocks, and the next round
begins.  A round takes as many pairs as leave the driver at most STRETCHES with STRETCH_IDS, and merges one at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.sources.storage import filesystem, shared_dir

from .bpe import MOST_IDS, SPECIALS, Merges, learn, train

#: Distinct pieces, and their bytes, up to which the driver trains by itself.
FEW_PIECES, FEW_BYTES = 100_000, 2_000_000
#: Distinct stretches of a round, and their ids, that the driver learns from.
STRETCHES, STRETCH_IDS = 100_000, 600_000
#: Pairs that the first round takes, and the most that any does.
AHEAD, MOST_AHEAD = 256, 32_768
#: Ids of a block; longer pieces stand whole in one.
BLOCK_IDS = 1 << 20
#: Rows of partial counts that a task holds before it passes them on.
HELD = 1 << 21
#: What stands after each piece; no id has it.
END = MOST_IDS - 1

_STATE = "ids binary, weights binary"


def _is_one_of(ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether each id and the one after it are one of some sorted pairs (left << 16 | right)."""
    left, right = np.zeros(MOST_IDS, bool), np.zeros(MOST_IDS, bool)
    left[pairs >> 16], right[pairs & 0xFFFF] = True, True
    found = left[ids[:-1]] & right[ids[1:]]
    at = np.flatnonzero(found)
    keys = ids[at].astype(np.int64) << 16 | ids[at + 1]
    found[at] = pairs[np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)] == keys
    return found


@dataclass
class Block:
    """Pieces as ids, END after each, and how often each piece occurs."""

    ids: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(pieces: list[bytes], weights: list[int], base: int) -> Block:
        flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + np.uint16(base)
        return Block(np.insert(flat, np.cumsum([len(x) for x in pieces]), END).astype(np.uint16) if pieces else flat, np.array(weights, np.int64))

    def _piece(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.flatnonzero(self.ids == END), at)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of neighbours, as left << 16 | right, and their weights."""
        at = np.flatnonzero((self.ids[:-1] != END) & (self.ids[1:] != END))
        return self.ids[at].astype(np.int64) << 16 | self.ids[at + 1], self.weights[self._piece(at)]

    def stretches(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left of the pieces where they are cut between neighbours that are none of some sorted pairs: the ids of
        all stretches of two or more, where each ends, and their weights."""
        hit = _is_one_of(self.ids, pairs)
        kept = np.append(hit, False) | np.append(False, hit)
        begins = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
        ends = np.flatnonzero(hit & ~np.append(hit[1:], False)) + 2
        return self.ids[kept], np.cumsum(ends - begins), self.weights[self._piece(begins)]

    def merged(self, known: Merges) -> Block:
        """The block after merges; pieces of a single id are left out, as they have no pair."""
        pairs = known.pairs >> 32 << 16 | known.pairs & 0xFFFF
        ends = np.flatnonzero(self.ids == END)
        sizes = np.diff(ends, prepend=-1) - 1
        touched = np.zeros(len(sizes), bool)
        touched[np.searchsorted(ends, np.flatnonzero(_is_one_of(self.ids, pairs)))] = True
        own = np.repeat(touched, sizes + 1)
        flat, n = known.together(self.ids[own & (self.ids != END)], sizes[touched])
        flat = np.insert(flat, np.cumsum(n), END).astype(np.uint16)
        flat = flat[np.repeat(n > 1, n + 1)]
        rest = np.repeat(~touched & (sizes > 1), sizes + 1)
        return Block(np.concatenate([self.ids[rest], flat]), np.concatenate([self.weights[~touched & (sizes > 1)], self.weights[touched][n > 1]]))


def _blocks(words: DataFrame, base: int) -> DataFrame:
    """(ids, weights): blocks of words (piece, cnt)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told():
            block = Block.of(pieces, weights, base)
            return pa.RecordBatch.from_arrays([pa.array([block.ids.tobytes()], pa.binary()), pa.array([block.weights.tobytes()], pa.binary())], ["ids", "weights"])

        pieces, weights, size = [], [], 0
        for batch in batches:
            for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces.append(piece)
                weights.append(n)
                size += len(piece) + 1
                if size >= BLOCK_IDS:
                    yield told()
                    pieces, weights, size = [], [], 0
        if pieces:
            yield told()

    return words.filter("piece != ''").select(F.encode("piece", "UTF-8").alias("piece"), F.col("cnt").cast("long").alias("cnt")).mapInArrow(run, _STATE)


def _read(batches: Iterator) -> Iterator[Block]:
    for batch in batches:
        for ids, weights in zip(batch.column(0), batch.column(1), strict=True):
            if len(ids.as_buffer()):
                yield Block(np.frombuffer(ids.as_buffer(), np.uint16), np.frombuffer(weights.as_buffer(), np.int64))


def _merged(state: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Merges([(k, *m) for k, m in enumerate(merges)], 0)
        for block in _read(batches):
            block = block.merged(known)
            yield pa.RecordBatch.from_arrays([pa.array([block.ids.tobytes()], pa.binary()), pa.array([block.weights.tobytes()], pa.binary())], ["ids", "weights"])

    return state.mapInArrow(run, _STATE)


def _summed(state: DataFrame, told, key: str) -> DataFrame:
    """(key, n): sums of what told gives for each block, an Arrow array of keys and one of numbers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0
        for block in _read(batches):
            held.append(pa.table(told(block), ["key", "n"]).group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"]))
            size += len(held[-1])
            if size > HELD:
                held = [pa.concat_tables(held).group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"])]
                size = len(held[0])
                if size > HELD // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from pa.concat_tables(held).group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"]).to_batches(1 << 16)

    return state.mapInArrow(run, f"key {key}, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _pairs(state: DataFrame) -> DataFrame:
    def told(block: Block):
        import pyarrow as pa

        return [pa.array(x) for x in block.pairs()]

    return _summed(state, told, "long")


def _stretches(state: DataFrame, pairs: list[int]) -> DataFrame:
    taken = np.sort(np.array(pairs, np.int64))

    def told(block: Block):
        import pyarrow as pa

        ids, ends, weights = block.stretches(taken)
        offsets = np.append(0, ends * 2).astype(np.int32)
        return [pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())]), pa.array(weights)]

    return _summed(state, told, "binary")


def _first(pairs: DataFrame, most: int, least: int) -> tuple[list[int], tuple[int, tuple[int, int]]]:
    """The pairs (key, n) that come first by count, then by ids: about most, one at least if there is any; and how far the
    order is complete, as (-count, pair)."""
    some, left = [], most
    for r in pairs.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect():
        if r.c > left:
            break
        some.append(r.n)
        left -= r.c
    else:
        return [r.key for r in pairs.select("key").collect()], (-least, (END, END))
    if some:
        return [r.key for r in pairs.filter(F.col("n") >= some[-1]).select("key").collect()], (-some[-1], (END, END))
    # One count has more pairs: those of its first left ids.
    tied, lefts = pairs.filter(F.col("n") == r.n), []
    for by in tied.groupBy(F.shiftright("key", 16).alias("a")).agg(F.count("*").alias("c")).orderBy("a").collect():
        if lefts and by.c > left:
            break
        lefts.append(by.a)
        left -= by.c
    found = sorted(x.key for x in tied.filter(F.shiftright("key", 16) <= lefts[-1]).select("key").collect())
    if len(found) > most:
        return found[:most], (-r.n, (found[most - 1] >> 16, found[most - 1] & 0xFFFF))
    return found, (-r.n, (lefts[-1], END))


def _preview(words: DataFrame, most: int) -> DataFrame:
    """About most of the pieces of words (piece, cnt), the most frequent: whole classes of like counts, and of the class that
    would be too many a part by a hash.  Tasks send the driver these rows alone, and not each its own first ones.  The
    trainer by stretches needs no preview; only a test calls this."""
    short = words.filter((F.octet_length("piece") > 0) & (F.col("cnt") > 0))
    step, left = F.floor(F.log2("cnt") * 8), most
    classes = short.groupBy(step.alias("k")).agg(F.count("*").alias("c")).orderBy(F.desc("k")).collect()
    for r in classes:
        if r.c > left:
            part = F.pmod(F.xxhash64("piece"), F.lit(r.c)) < left
            return short.filter((step > r.k) | ((step == r.k) & part))
        left -= r.c
    return short


def _remove(path: str) -> None:
    fs, folder = filesystem(path)
    fs.delete_dir(folder)


def train_spread(words: DataFrame, vocab_size: int, min_frequency: int = 2, specials: int = len(SPECIALS), ahead: int = AHEAD) -> list[tuple[int, int, int, int]]:
    """What bpe.train gives for words (piece, cnt), each piece once, however many there are."""
    import uuid

    if vocab_size > END:
        raise ValueError("more ids than two bytes hold")
    spark = words.sparkSession
    folder = f"{shared_dir(spark)}/tidewell-merges-{uuid.uuid4().hex}"
    written = 0

    def put(rows: DataFrame) -> tuple[DataFrame, str]:
        nonlocal written
        written += 1
        rows.write.option("compression", "uncompressed").parquet(f"{folder}/{written}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{written}"), f"{folder}/{written}"

    first = specials + 256
    state, at = put(_blocks(words, specials))
    merges: list[tuple[int, int, int]] = []
    while len(merges) < vocab_size - first:
        pairs, pairs_at = put(_pairs(state).filter(F.col("n") >= min_frequency))
        wanted = vocab_size - first - len(merges)
        while True:
            taken, last = _first(pairs, min(ahead, wanted), min_frequency)
            if len(taken) < 2:
                found = [(taken[0] >> 16, taken[0] & 0xFFFF, first + len(merges))] if taken else []
                break
            stretches, stretches_at = put(_stretches(state, taken))
            n, size = stretches.agg(F.count("*"), F.sum(F.octet_length("key")) / 2).first()
            share = max(n / STRETCHES, size / STRETCH_IDS)
            if share <= 1:
                rows = stretches.toArrow()
                split = [np.frombuffer(x.as_buffer(), np.uint16).tolist() for x in rows.column("key")]
                found = learn(split, rows.column("n").to_pylist(), first + len(merges), wanted, last)
            _remove(stretches_at)
            ahead = max(1, min(int(len(taken) * min(4, max(0.1, 0.6 / share))), len(taken) // 2 if share > 1 else MOST_AHEAD))
            if share <= 1:
                break
        _remove(pairs_at)
        if not found:
            break
        merges += found
        if len(merges) < vocab_size - first:
            before = at
            state, at = put(_merged(state, found))
            _remove(before)
    _remove(folder)
    return [(k, *m) for k, m in enumerate(merges)]


def train_table(words: DataFrame, vocab_size: int, min_frequency: int = 2, specials: int = len(SPECIALS)) -> list[tuple[int, int, int, int]]:
    """Merges over words (piece, cnt), each piece once: on the driver if they are few, else where they are."""
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()
    if n <= FEW_PIECES and size <= FEW_BYTES:
        return train({r.piece.encode(): r.cnt for r in words.collect()}, vocab_size, min_frequency, specials)
    return train_spread(words, vocab_size, min_frequency, specials)
