"""Token-id shards as sorted string tables.

A shard file holds documents in ascending key order::

    data block*  filter block  index block  footer

    data block   zstd of: entry*, restart offsets (u32 each), their number (u32)
    entry        varint shared, varint unshared, varint value length, key suffix, value
                 (every RESTART_EVERY entries the key is whole)
    value        one byte of id width (2 or 4), then the ids little-endian
    filter       Bloom filter: u32 number of probes, then the bits
    index        for each data block: last key, offset, length, documents and ids before it
    footer       offsets and lengths of filter and index, documents, ids, magic

A key is the doc_id as eight big-endian bytes with its sign bit flipped, so bytes sort as numbers; a row
without a doc_id has the empty key, which comes first.  Look-ups ask the Bloom filter, then search the sparse
index and the restarts of one block by halves.

Texts are encoded first, so that ids and not texts are ordered by key.  Their bytes tell the number of ranges; a
range is written as one shard after another, none of more than SHARD_BYTES or SHARD_DOCS, by the executors with pyarrow's file systems
into the folder all of them share.  A file gets its name only when it is whole, so a repeated or lost task leaves
no torn shard.  The manifest has each shard's first and last key, which a look-up asks first.

Defined results: a null text has no ids but the end id; rows that repeat a doc_id are kept, in the order of
a hash of their ids, and may be parted among ranges; an empty table has no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.sources.storage import filesystem, publish, qualified

from .common import fresh_path, parallelism, written
from .encoding import encoder

MAGIC = b"TWSST001"
BLOCK_BYTES = 1 << 18
#: A shard ends with the document that reaches one of these; a range of keys is made for so many bytes.
SHARD_BYTES = 128 << 20
SHARD_DOCS = 500_000
LEAST_RANGE = 4 << 20
RESTART_EVERY = 16
BITS_PER_KEY = 10
PROBES = 7
FOOTER = struct.Struct("<QQQQQQ8s")
INDEX = struct.Struct("<QQQQ")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class ShardWriter:
    def __init__(self, out):
        import zstandard

        self.out, self.at = out, 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.docs = self.ids = 0
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""
        self.before = self.docs, self.ids

    def add(self, key: bytes, ids: np.ndarray) -> None:
        self.add_packed(key, pack_ids(ids))

    def add_packed(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries % RESTART_EVERY:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.entries = key, self.entries + 1
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.docs += 1
        self.ids += (len(value) - 1) // value[0]
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            data = self.zip.compress(bytes(self.block))
            self.index.append(_varint(len(self.last)) + self.last + INDEX.pack(self.at, len(data), *self.before))
            self._put(data)
        self._open()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def close(self) -> None:
        self._flush()
        bits = max(64, BITS_PER_KEY * len(self.keys)) + 7 & ~7
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        where = self._put(struct.pack("<I", PROBES) + np.packbits(bloom, bitorder="little").tobytes())
        where += self._put(b"".join(self.index))
        self._put(FOOTER.pack(*where, self.docs, self.ids, MAGIC))


class ShardReader:
    """Reads one shard from a seekable file."""

    def __init__(self, file):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        file.seek(0, 2)
        size = file.tell()
        f_at, f_len, i_at, i_len, self.docs, self.ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom = self._read(f_at, f_len)[4:]
        index, at, self.blocks = self._read(i_at, i_len), 0, []
        while at < len(index):
            n, at = _read_varint(index, at)
            self.blocks.append((index[at : at + n], *INDEX.unpack_from(index, at + n)))
            at += n + INDEX.size

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * len(self.bloom)))

    def _block(self, k: int) -> tuple[bytes, list[int], int]:
        _, at, n, *_ = self.blocks[k]
        data = self.unzip.decompress(self._read(at, n))
        (count,) = struct.unpack_from("<I", data, len(data) - 4)
        end = len(data) - 4 - 4 * count
        return data, list(struct.unpack_from(f"<{count}I", data, end)), end

    @staticmethod
    def _entries(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            data, _, end = self._block(k)
            for key, value in self._entries(data, 0, end):
                yield key, unpack_ids(value)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document of this key; None if there is none."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return None
        for k in range(bisect_left([b[0] for b in self.blocks], key), len(self.blocks)):
            data, restarts, end = self._block(k)
            whole = [next(self._entries(data, at, end))[0] for at in restarts]
            for found, value in self._entries(data, restarts[max(0, bisect_left(whole, key) - 1)], end):
                if found == key:
                    return unpack_ids(value)
                if found > key:
                    return None
        return None


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, ids, n_bytes, h, row), written: the packed ids of each row with the end id, their hash and a row number."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, end = encoder(vocabulary).encode, struct.pack("<I", end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                ids = [pack_ids(np.frombuffer(x + end, "<u4")) for x in encode(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")
    return written(found.select("doc_id", "ids", F.octet_length("ids").cast("long").alias("n_bytes"), F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row")), "encoded", "zstd")


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, ranges: int | None = None, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes docs (doc_id, text) and returns the manifest (shard, part, path, first_id, last_id, n_docs, n_ids), a row
    for each shard; (shard, part) is their order."""
    spark = docs.sparkSession
    ids, path = encoded(docs, vocabulary, end_id), qualified(spark, path)
    if ranges is None:
        total = ids.agg(F.sum("n_bytes")).first()[0] or 0
        ranges = max(1, -(-total // shard_bytes), min(parallelism(spark), total // LEAST_RANGE))

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, part = TaskContext.get(), 0
        shard = task.partitionId()
        fs, folder = filesystem(path)
        out = writer = first = last = None
        own = f"{folder}/shard-{shard:06d}.{task.taskAttemptId()}"

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            name = f"shard-{shard:06d}-{part:06d}.sst"
            publish(fs, own, f"{folder}/{name}")
            longs = {"first_id": [first], "last_id": [last], "n_docs": [writer.docs], "n_ids": [writer.ids]}
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "path": [f"{path}/{name}"]} | {k: pa.array(v, pa.int64()) for k, v in longs.items()})

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(own)
                    writer, first = ShardWriter(out), doc_id
                writer.add_packed(key_of(doc_id), value)
                last = doc_id
                if writer.at + len(writer.block) >= shard_bytes or writer.docs >= shard_docs:
                    yield closed()
                    writer, part = None, part + 1
        if writer is not None:
            yield closed()

    order = [F.col("doc_id").asc_nulls_first(), "h", "row"]
    dealt = ids.select("doc_id", "ids", "h", "row").repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return written(dealt.mapInArrow(write, "shard int, part int, path string, first_id long, last_id long, n_docs long, n_ids long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards of a manifest."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = filesystem(path)
                rows: list[list] = [[], [], [], []]
                with fs.open_input_file(name) as file:
                    for key, ids in ShardReader(file).scan():
                        for column, x in zip(rows, (id_of(key), start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                            column.append(x)
                        start += len(ids)
                        if len(rows[0]) >= 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names)
                            rows = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names)

    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a shard
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    spread = placed.repartition(max(1, parallelism(manifest.sparkSession)), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int | None) -> np.ndarray | None:
    """The ids of one document: the manifest's key ranges leave few shards, then their filters and indexes are asked."""
    holds = F.col("first_id").isNull() if doc_id is None else (F.coalesce(F.col("first_id") <= doc_id, F.lit(True)) & (F.col("last_id") >= doc_id))
    for row in manifest.filter(holds).orderBy("shard", "part").select("path").toLocalIterator():
        fs, name = filesystem(row.path)
        with fs.open_input_file(name) as file:
            found = ShardReader(file).get(doc_id)
        if found is not None:
            return found
    return None


def digest(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    return read_shards(write_shards(docs, fresh_path(docs.sparkSession, "shards"), vocabulary, end_id))
