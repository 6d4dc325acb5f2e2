"""Language-model scores by context-tree weighting over bytes, beside a smoothed unigram model of words.

The byte model.  A text is coded as its words (A-Z lower-cased) with one blank between, then an end byte; its
first bytes see DEPTH start bytes.  A byte is eight binary decisions, each with a context tree of its own:
the node of depth d is the last d bytes.  Every node holds the training counts of zeros and ones; with Pe the
Krichevsky-Trofimov probability of its counts, its weighted probability is Pe at depth DEPTH and
(Pe + product of its children's weighted probabilities) / 2 above.  The training counts are then frozen, and
a decision's probability is the same mixture of the estimates of all depths along its context,

    p(d) = w(d) * kt(d) + (1 - w(d)) * p(d + 1),   w = Pe / (Pe + product of children),

so a text's log probability is a sum over its bytes, whatever the order of the documents; bits_per_byte is its code
length over its coded bytes, the end byte among them.

How it runs.  Documents are written once in chunks of some CHUNK_BYTES, whatever the size of an input partition.  Each chunk yields its distinct keys: contexts with their
byte (DEPTH + 1 bytes in a long) and hashes of its words, with training counts; these are what the cluster
shuffles.  Nodes below depth SPLIT are mixed in groups of one depth-SPLIT context; sums over these give the few
nodes above (at most 2**24 at any input).  Every key's value goes back to the chunks that asked for it, as
one sorted file a chunk in the shared folder, and each chunk is scored with its own file alone.

Words are counted by 63-bit hashes: two of a million different words share one with odds of about 1 in 18
million.

Defined results: a null or blank text is its end alone; rows that repeat a doc_id count and are scored each;
rows without doc_id are held in training; with no training text every decision is 1/2 and base_score is 0;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.sources.storage import filesystem, publish, qualified

from .common import fresh_path, id_hash_mod, parallelism, written

DEPTH = 5
#: Nodes of at least this depth are mixed in parallel groups; those above by the driver.
SPLIT = 3
EDGE = 255  # no byte of UTF-8: before the first byte and after the last
SMOOTHING = 0.1
#: Bytes of text, and rows of nodes, that are worked on at once.
TOGETHER = 1 << 22
ROWS_TOGETHER = 1 << 18
#: Bytes of text in a chunk, but for its last document; a chunk's keys and values are held by one task.
CHUNK_BYTES = 32 << 20
#: Keys and chunks that a task takes, beyond the session's number of shuffle partitions.
KEYS_A_TASK = 16_000_000
CHUNKS_A_TASK = 8
#: Distinct keys that a task holds: a chunk with more tells them in several runs, and has its values read frame by frame.
HELD_KEYS = 1 << 21
FRAME_KEYS = 1 << 18
_WORD = 1 << 63
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


# --- keys of texts -------------------------------------------------------------------------------------


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def stretches(text: bytes) -> Iterator[tuple[list[bytes], bytes]]:
    """A long text in stretches of some TOGETHER bytes, none of which parts a word: tokens, and what is coded of them.
    The last has the end token, of no bytes, and the end byte."""
    a, gap = 0, b""
    while a < len(text):
        blank = _BLANK.search(text, a + TOGETHER) if len(text) - a > TOGETHER else None
        end = blank.start() if blank else len(text)
        words = text[a:end].lower().split()
        if words:
            yield words, gap + b" ".join(words)
            gap = b" "
        a = end + 1
    yield [b""], bytes([EDGE])


def _byte_keys(raw: np.ndarray, depth: int) -> np.ndarray:
    """Keys of all bytes but the first depth."""
    n = len(raw) - depth
    key = raw[depth:].astype(np.int64)
    for back in range(1, depth + 1):
        key |= raw[depth - back : depth - back + n].astype(np.int64) << (8 * (depth + 1 - back))
    return key


def long_keys(before: bytes, coded: bytes, depth: int) -> Iterator[np.ndarray]:
    """Keys of the bytes of a stretch, TOGETHER at once; before: what is coded before them, depth bytes at least."""
    for a in range(0, len(coded), TOGETHER):
        head = coded[max(0, a - depth) : a] if a else before[-depth:]
        yield _byte_keys(np.frombuffer(head + coded[a : a + TOGETHER], np.uint8), depth)


def context_keys(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all coded bytes, in order, and where each text's begin.

    The highest byte is the last byte before, then the one before that, and so on; the lowest is the byte
    itself, so keys sort as a walk through the tree.
    """
    edge = bytes([EDGE])
    raw = np.frombuffer(b"".join([edge * depth + t + edge for t in texts]), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    key = _byte_keys(raw, depth)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = np.ones(len(key), bool)
    for k in range(depth):  # the start bytes of every text but the first
        inside[starts[1:] + np.arange(1, len(texts)) * depth - depth + k] = False
    return key[inside], starts


def word_keys(words: list[bytes]) -> np.ndarray:
    """Negative longs; the end token is the hash of no bytes."""
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return (h | np.uint64(_WORD)).view(np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n, first)


class _Keys:
    """The distinct keys of a chunk with their training counts.  Beyond HELD_KEYS they are told in several runs, whose
    keys may repeat, as counts of a key are summed later."""

    def __init__(self, depth: int):
        self.depth, self.texts, self.size = depth, {True: [], False: []}, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, text: bytes | None, train: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes a text; gives runs of keys and counts that are full."""
        if len(text or b"") > TOGETHER:
            before = bytes([EDGE]) * self.depth
            for words, coded in stretches(text):
                self._put_words(Counter(words), train)
                for keys in long_keys(before, coded, self.depth):
                    self._put(*np.unique(keys, return_counts=True), train)
                    yield from self._full()
                before = (before + coded[-self.depth :])[-self.depth :]
            return
        self.texts[train].append(tokens(text))
        self.size += len(text or b"")
        if self.size >= TOGETHER:
            self._count()
            yield from self._full()

    def _put(self, keys: np.ndarray, counts: np.ndarray, train: bool) -> None:
        self.parts.append((keys, counts.astype(np.int64) * train))
        self.rows += len(keys)

    def _put_words(self, seen: Counter, train: bool) -> None:
        self._put(word_keys(list(seen)), np.fromiter(seen.values(), np.int64, len(seen)), train)

    def _count(self) -> None:
        for train, split in self.texts.items():
            if split:
                seen = Counter()
                for words in split:
                    seen.update(words)
                seen[b""] = len(split)
                self._put(*np.unique(context_keys([b" ".join(w) for w in split], self.depth)[0], return_counts=True), train)
                self._put_words(seen, train)
        self.texts, self.size = {True: [], False: []}, 0

    def _full(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(self.parts) > 4 and self.rows > 4 * ROWS_TOGETHER and self.rows > 2 * len(self.parts[0][0]):
            self._merge()
        if self.rows > 2 * HELD_KEYS or (len(self.parts) == 1 and self.rows > HELD_KEYS):
            yield self._taken()

    def _merge(self) -> None:
        self.parts = [_merged([k for k, _ in self.parts], [n for _, n in self.parts])]
        self.rows = len(self.parts[0][0])

    def _taken(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        (run,), self.parts, self.rows = self.parts, [], 0
        return run

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self._count()
        return self._taken()


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, doc_id, train, text): docs in chunks, numbered within each input partition."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        first, before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if first is None:
                first = batch.column(0)[0].as_py() << 32
            sizes = pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes) + before
            chunk = (ends - sizes) // chunk_bytes + first
            before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array(chunk), *batch.columns[1:]], ["chunk", "doc_id", "train", "text"])

    return docs.select(F.spark_partition_id().cast("long").alias("chunk"), "doc_id", "train", "text").mapInArrow(run, "chunk long, doc_id long, train boolean, text string")


def chunk_keys(chunks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(chunk, key, n): distinct keys of each chunk, with counts from training texts (0: met elsewhere only)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, keys = None, None

        def told(k: np.ndarray, n: np.ndarray) -> Iterator:
            for a in range(0, len(k), 1 << 17):
                own = k[a : a + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), at, np.int64)), pa.array(own), pa.array(n[a : a + (1 << 17)])], ["chunk", "key", "n"])

        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for chunk, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                if chunk != at:
                    if keys:
                        yield from told(*keys.result())
                    at, keys = chunk, _Keys(depth)
                for run in keys.add(text.as_py(), train):
                    yield from told(*run)
        if keys:
            yield from told(*keys.result())

    return chunks.select("chunk", "train", "text").mapInArrow(run, "chunk long, key long, n long")


# --- the tree ------------------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma by Stirling's series, shifted to where it is exact to double precision."""
    y = x + 8
    product = x * (x + 1) * (x + 2) * (x + 3)
    product2 = (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(product) - np.log(product2)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of these counts."""
    return np.where(zeros + ones == 0, 0.0, _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi))


def _nodes(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For decision k: distinct nodes (context, first k bits) of sorted keys, zeros, ones, and each key's node."""
    prefix = keys >> (8 - k)
    first = np.concatenate([[True], prefix[1:] != prefix[:-1]])
    of = np.cumsum(first) - 1
    ones = (keys >> (7 - k) & 1).astype(bool)
    n1 = np.bincount(of, counts * ones, minlength=of[-1] + 1)
    return prefix[first], np.bincount(of, counts, minlength=of[-1] + 1) - n1, n1, of


def _weights(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's weight of its own estimate, and its ln weighted probability; below: sum over its children."""
    own = log_kt(zeros, ones)
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.logaddexp(own, below) - math.log(2)


def mix_below(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, split: int = SPLIT) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Mixed probabilities of the eight decisions of each key (sorted, distinct) from depth to split, and the sums
    of the split nodes by their parents: node, zeros, ones, ln weighted probability."""
    p = np.zeros((len(keys), 8))
    levels = []
    for d in range(depth, split - 1, -1):
        own = (keys >> (8 * (depth - d) + 8) << 8) | (keys & 255)
        u, inverse = (own, np.arange(len(own))) if d == depth else np.unique(own, return_inverse=True)
        levels.append((u, np.bincount(inverse, counts, minlength=len(u)), inverse))
    parents = {"node": [], "zeros": [], "ones": [], "weighted": []}
    for k in range(8):
        before = weighted = None
        for u, n, inverse in levels:
            node, zeros, ones, of = _nodes(u, n, k)
            bit = u >> (7 - k) & 1
            kt = (np.where(bit == 1, ones[of], zeros[of]) + 0.5) / (zeros + ones + 1)[of]
            if before is None:
                p[:, k], weighted = kt[inverse], log_kt(zeros, ones)
            else:
                low = before & ((1 << k) - 1)
                below = np.bincount(np.searchsorted(node, (before >> (k + 8) << k) | low), weighted, minlength=len(node))
                w, weighted = _weights(zeros, ones, below)
                p[:, k] = (w[of] * kt)[inverse] + (1 - w[of])[inverse] * p[:, k]
            before = node
        # Parents of the split nodes: one byte of context less, and the decision's place with a leading one.
        parent = (before >> (k + 8) << 8) | (1 << k) | (before & ((1 << k) - 1))
        own, inverse = np.unique(parent, return_inverse=True)
        for name, x in (("node", own), ("zeros", np.bincount(inverse, zeros)), ("ones", np.bincount(inverse, ones)), ("weighted", np.bincount(inverse, weighted))):
            parents[name].append(x)
    return p, {k: np.concatenate(v) for k, v in parents.items()}


class Top:
    """The nodes above the split: sorted by (context, decision), with weights and estimates."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, split: int = SPLIT):
        self.split = split
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(node)
        node, zeros, ones, below = node[order], zeros[order], ones[order], below[order]
        for _ in range(split):
            w, weighted = _weights(zeros, ones, below)
            self.levels.append((node, w, (ones + 0.5) / (zeros + ones + 1)))
            up = (node >> 16 << 8) | (node & 255)
            node, inverse = np.unique(up, return_inverse=True)
            zeros, ones, below = (np.bincount(inverse, x, minlength=len(node)) for x in (zeros, ones, weighted))

    def log10(self, keys: np.ndarray, p: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """log10 probability of each key's byte; p: its decisions mixed up to the split."""
        out = np.zeros(len(keys))
        byte = keys & 255
        for k in range(8):
            bit, place = byte >> (7 - k) & 1, (1 << k) | (byte >> (8 - k))
            mixed = p[:, k].astype(np.float64)
            for up, (node, w, one) in enumerate(self.levels):
                d = self.split - 1 - up
                at = np.searchsorted(node, (keys >> (8 * (depth - d) + 8) << 8) | place)
                mixed = w[at] * np.where(bit == 1, one[at], 1 - one[at]) + (1 - w[at]) * mixed
            out += np.log10(mixed)
        return out


def _grouped(keys: DataFrame, depth: int) -> DataFrame:
    """(key, p, zeros, ones, weighted): a row for each context key with its packed p, and rows of parents' sums without p."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["key", "p", "zeros", "ones", "weighted"]

        def told(k: np.ndarray, n: np.ndarray) -> Iterator:
            p, up = mix_below(k, n, depth)
            none = pa.nulls(len(k), pa.float64())
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(k), [None, pa.py_buffer(np.ascontiguousarray(p, np.float32))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(k), packed, none, none, none], names)
            yield pa.RecordBatch.from_arrays([pa.array(up["node"]), pa.nulls(len(up["node"]), pa.binary()), *(pa.array(up[c].astype(np.float64)) for c in names[2:])], names)

        left_k, left_n = [], []
        for batch in batches:
            left_k.append(batch.column(0).to_numpy())
            left_n.append(batch.column(1).to_numpy())
            if sum(map(len, left_k)) >= ROWS_TOGETHER:
                k, n = np.concatenate(left_k), np.concatenate(left_n)
                group = k >> (8 * (depth - SPLIT) + 8)
                cut = int(np.searchsorted(group, group[-1]))
                if cut:
                    yield from told(k[:cut], n[:cut])
                left_k, left_n = [k[cut:]], [n[cut:]]
        if left_k and sum(map(len, left_k)):
            yield from told(np.concatenate(left_k), np.concatenate(left_n))

    spark = keys.sparkSession
    total = keys.filter("key >= 0").groupBy("key").agg(F.sum("n").alias("n"))
    group = F.shiftright("key", 8 * (depth - SPLIT) + 8)
    # Tasks of a bounded size: keys without the chunk are no more than these.
    tasks = max(parallelism(spark), keys.count() // KEYS_A_TASK)
    return total.repartition(tasks, group).sortWithinPartitions("key").mapInArrow(run, "key long, p binary, zeros double, ones double, weighted double")


def byte_values(keys: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, value): log10 probability of the byte of each context key."""
    mixed = written(_grouped(keys, depth), "nodes", "zstd")
    # At most 2**16 contexts of 255 decisions each, at any size of the input.
    rows = mixed.filter("p IS NULL").groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).toPandas()
    top = keys.sparkSession.sparkContext.broadcast(Top(*(rows[c].to_numpy() for c in ("key", "zeros", "ones", "weighted"))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            k = batch.column(0).to_numpy()
            p = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(top.value.log10(k, p, depth) if len(k) else np.zeros(0))], ["key", "value"])

    return mixed.filter("p IS NOT NULL").select("key", "p").mapInArrow(run, "key long, value double")


# --- values for each chunk -----------------------------------------------------------------------------


class _Frames:
    """A file of sorted keys and their values in frames of FRAME_KEYS, then each frame's first key, size and place."""

    def __init__(self, fs, name: str):
        self.name, self.file, self.index, self.parts, self.rows = name, fs.open_output_stream(name), [], [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.parts.append((keys.copy(), values.copy()))
        self.rows += len(keys)
        if self.rows >= FRAME_KEYS:
            self._put()

    def _put(self) -> None:
        import zstandard

        k, v = (np.concatenate([p[c] for p in self.parts]) for c in (0, 1))
        self.index.append((int(k[0]), len(k), self.file.tell()))
        self.file.write(zstandard.ZstdCompressor(level=1).compress(k.tobytes() + v.tobytes()))
        self.parts, self.rows = [], 0

    def close(self) -> None:
        if self.rows:
            self._put()
        end = self.file.tell()
        self.file.write(np.array(self.index, np.int64).tobytes() + struct.pack("<2q", len(self.index), end))
        self.file.close()


def write_values(keys: DataFrame, values: DataFrame, path: str) -> DataFrame:
    """Writes each chunk's keys and values as one sorted file; returns (chunk, words, train_tokens) to be summed:
    distinct training words and training tokens, each counted in one chunk."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        at, out, words, total = None, None, 0, 0

        def put() -> dict:
            out.close()
            publish(fs, out.name, f"{folder}/chunk-{at:016x}")
            return {"chunk": pa.array([at], pa.int64()), "words": [words], "train_tokens": [total]}

        for batch in batches:
            chunk = batch.column(0).to_numpy()
            k, v, first, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 4))
            for a in np.flatnonzero(np.concatenate([[len(chunk) > 0], chunk[1:] != chunk[:-1]])):
                b = a + int(np.searchsorted(chunk[a:], chunk[a], side="right"))
                if chunk[a] != at:
                    if out:
                        yield pa.RecordBatch.from_pydict(put())
                    at, words, total = int(chunk[a]), 0, 0
                    out = _Frames(fs, f"{folder}/chunk-{at:016x}.{attempt}")
                out.add(k[a:b], v[a:b])
                is_word = k[a:b] < 0
                words += int((first[a:b] & is_word & (v[a:b] > 0)).sum())
                total += int(n[a:b][is_word].sum())
        if out:
            yield pa.RecordBatch.from_pydict(put())

    spark = keys.sparkSession
    over = Window.partitionBy("key")
    words = keys.filter("key < 0").select("chunk", "key", F.sum("n").over(over).cast("double").alias("value"), (F.row_number().over(over.orderBy("chunk")) == 1).alias("first"), "n")
    contexts = keys.filter("key >= 0").join(values, "key").select("chunk", "key", "value", F.lit(False).alias("first"), "n")
    chunks = keys.agg(F.count_distinct("chunk")).first()[0]
    dealt = words.unionByName(contexts).repartition(max(parallelism(spark), chunks // CHUNKS_A_TASK), "chunk").sortWithinPartitions("chunk", "key")
    return written(dealt.mapInArrow(run, "chunk long, words long, train_tokens long"), "values")


class _Values:
    """Values by key, from a chunk's file: a table of hashed slots, and halving for keys whose slot another holds.  Of
    a file with over HELD_KEYS, the frames that some keys ask for are read one by one instead."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 16)
        frames, self.end = struct.unpack("<2q", file.read(16))
        file.seek(self.end)
        self.index = np.frombuffer(file.read(24 * frames), np.int64).reshape(-1, 3)
        self.held = int(self.index[:, 1].sum()) <= HELD_KEYS
        if not self.held:
            return
        keys, values = (np.concatenate(c) for c in zip(*map(self._frame, range(frames)), strict=True))
        split = int(np.searchsorted(keys, 0))
        self.word_keys, self.word_values = keys[:split], values[:split]
        self.context_keys, self.context_values = keys[split:], values[split:]
        self.bits = min(23, max(4, int(len(self.context_keys) * 4).bit_length()))
        self.slot_keys = np.full(1 << self.bits, -1, np.int64)
        self.slot_values = np.zeros(1 << self.bits)
        at = self._slots(self.context_keys)
        self.slot_keys[at], self.slot_values[at] = self.context_keys, self.context_values

    def _frame(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        import zstandard

        _, n, at = map(int, self.index[k])
        end = int(self.index[k + 1, 2]) if k + 1 < len(self.index) else self.end
        self.file.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(end - at), max_output_size=16 * n)
        return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.float64, n, 8 * n)

    def _read(self, k: np.ndarray) -> np.ndarray:
        """Values of keys of the file, a frame at a time; keys that repeat have one value."""
        own, back = np.unique(k, return_inverse=True)
        of = np.maximum(np.searchsorted(self.index[:, 0], own, side="right") - 1, 0)
        out = np.empty(len(own))
        for f in np.unique(of):
            a, b = np.searchsorted(of, [f, f + 1])
            keys, values = self._frame(f)
            out[a:b] = values[np.searchsorted(keys, own[a:b])]
        return out[back]

    def _slots(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def contexts(self, k: np.ndarray) -> np.ndarray:
        if not self.held:
            return self._read(k)
        at = self._slots(k)
        out = self.slot_values[at]
        other = np.flatnonzero(self.slot_keys[at] != k)
        out[other] = self.context_values[np.searchsorted(self.context_keys, k[other])]
        return out

    def words(self, k: np.ndarray) -> np.ndarray:
        """Training counts."""
        if not self.held:
            return self._read(k)
        return self.word_values[np.searchsorted(self.word_keys, k)]


def score_chunks(chunks: DataFrame, path: str, total: int, distinct: int, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, bits_per_byte) of every document in chunks."""

    def scored(own: _Values, texts: list[bytes | None]) -> list[np.ndarray]:
        split = [tokens(t) for t in texts]
        sizes = np.array([len(w) + 1 for w in split], np.int64)
        seen = list(set().union(*split))
        counts = own.words(word_keys([*seen, b""]))
        number = dict(zip(seen, range(len(seen)), strict=True))
        flat = np.concatenate([np.fromiter((*map(number.__getitem__, w), len(seen)), np.int64, len(w) + 1) for w in split])
        logs = np.log10((counts + SMOOTHING) / (total + SMOOTHING * (distinct + 1)))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        keys, at = context_keys([b" ".join(w) for w in split], depth)
        score = np.add.reduceat(own.contexts(keys), at)
        coded = np.diff(np.append(at, len(keys)))
        return [sizes, np.add.reduceat((counts > 0).astype(np.int64)[flat], starts), np.add.reduceat(logs[flat], starts), score, -score * math.log2(10) / coded]

    def scored_long(own: _Values, text: bytes) -> list[np.ndarray]:
        n = known = coded = 0
        base = score = 0.0
        before = bytes([EDGE]) * depth
        for words, raw in stretches(text):
            seen = Counter(words)
            counts, times = own.words(word_keys(list(seen))), np.fromiter(seen.values(), np.int64, len(seen))
            n, known = n + len(words), known + int(times[counts > 0].sum())
            base += float((np.log10((counts + SMOOTHING) / (total + SMOOTHING * (distinct + 1))) * times).sum())
            for keys in long_keys(before, raw, depth):
                score, coded = score + float(own.contexts(keys).sum()), coded + len(keys)
            before = (before + raw[-depth:])[-depth:]
        return [np.array([x]) for x in (n, known, base, score, -score * math.log2(10) / coded)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, folder = filesystem(path)
        at, own, file = None, None, None
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]
        for batch in batches:
            chunk, texts = batch.column(0).to_pylist(), batch.column(2).cast(pa.large_binary())
            a = 0
            while a < len(chunk):
                if chunk[a] != at:
                    if file:
                        file.close()
                    at, own = chunk[a], None
                    file = fs.open_input_file(f"{folder}/chunk-{at:016x}")
                    own = _Values(file)
                held, size, b = [], 0, a
                while b < len(chunk) and chunk[b] == at and (size < TOGETHER or b == a):
                    text = texts[b].as_py()
                    if held and len(text or b"") > TOGETHER:
                        break
                    held.append(text)
                    size += len(text or b"")
                    b += 1
                found = scored_long(own, held[0]) if size > TOGETHER and len(held) == 1 else scored(own, held)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *(pa.array(x) for x in found)], names)
                a = b

    return chunks.select("chunk", "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_hash_mod(doc_id, 10) == 0, F.lit(False))


def score(docs: DataFrame, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The digest of every document; fits on those that are not held out."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    chunk_path = fresh_path(spark, "chunks")
    chunked(docs.select(doc_id.alias("doc_id"), (~held_out(doc_id)).alias("train"), "text"), chunk_bytes).write.option("compression", "zstd").parquet(chunk_path)
    chunks = spark.read.schema("chunk long, doc_id long, train boolean, text string").parquet(chunk_path)
    keys = written(chunk_keys(chunks, depth), "keys", "zstd")
    path = qualified(spark, fresh_path(spark, "values"))
    totals = write_values(keys, byte_values(keys, depth), path).agg(F.sum("words"), F.sum("train_tokens")).first()
    distinct, total = totals[0] or 0, totals[1] or 0
    found = score_chunks(chunks, path, total, distinct, depth)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
