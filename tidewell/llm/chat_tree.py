"""Conversations as a prefix tree whose shared turns are emitted once.

A turn's node is the hash of its role and text and of its ancestors, so conversations with equal first turns share
nodes.  A segment is a stretch of nodes without a fork or an end of a conversation in it; its place in depth-first order
is that of its path (the hashes of its ancestors' segments and its own) among all paths, and a running sum over that order
gives the offset of its tokens in the stream.  A token's position id counts the tokens of its ancestors and of
its own node before it; it attends to the intervals of its ancestors' segments, and in its own segment to what stands before.

The template is ``### role:``, a line feed, the text, ``</turn>``, a line feed.  A backslash parts what would read as a mark
inside texts and roles, and backslashes are doubled, so the texts come back exactly.

Defined results: null texts and roles are empty; turns are ordered by turn (null first), then role, then text, and
repeated ones count each; rows without conv_id are one conversation; other columns are ignored; an empty table
gives an empty one.  Turns stream through tasks one after another, so a conversation may be of any length; paths and
intervals grow with the forks on the way to a segment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_PARTS, join_counted, parallelism, written
from .encoding import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
TRAINED_ROLE = "assistant"
TURN, TURN_END = "### ", "</turn>\n"
NODE_BYTES = 16
#: Rows of one key from which on it is dealt apart.
HOT_ROWS = 200
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*):\n(.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    text = re.sub("#(?=##)", r"#\\", text.replace("\\", "\\\\"))
    return text.replace("</turn>", "<\\/turn>").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """A turn before its text, the text, and what follows it."""
    return f"{TURN}{escape(role).replace(':', chr(92) + ':')}:\n", escape(text), TURN_END


def parsed(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = _TURN.fullmatch(turn)
    if not m:
        raise ValueError(f"no turn of the template: {turn[:80]!r}")
    return unescape(m[1]), unescape(m[2])


_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


@dataclass
class Tree:
    """The tables of a written tree.

    stream: (offset, position, segment, n_tokens, ids, loss_from, loss_to), a row a node in the order of offset; ids are
    little-endian unsigned 32-bit integers, loss_from and loss_to the node's own places of the text under the loss.
    segments: (segment, length, position, ancestors, intervals); a segment is named by its offset, ancestors are segments
    from the root on, intervals are their stretches of the stream, joined where they touch.
    conversations: (conv_id, segment), the segment that ends it.
    """

    stream: DataFrame
    segments: DataFrame
    conversations: DataFrame


def _chained(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, role, text, last): turns in order; the parent of a first turn is empty."""
    empty = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    dealt = rows.repartition(parallelism(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["conv_id", "depth", "node", "parent", "role", "text", "last"]
        held, key, depth, parent, node = None, None, 0, b"", b""

        def batch_of(rows: list[tuple]):
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                going_on = held is not None and conv_id == key
                if held is not None:
                    out.append((*held, not going_on))
                depth, parent = (depth + 1, node) if going_on else (0, b"")
                name = role.encode()
                node = hashlib.blake2b(parent.rjust(NODE_BYTES, b"\0") + len(name).to_bytes(8, "little") + name + text.encode(), digest_size=NODE_BYTES).digest()
                key, held = conv_id, (conv_id, depth, node, parent, role, text)
            if out:
                yield batch_of(out)
        if held is not None:
            yield batch_of([(*held, True)])

    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, depth long, node binary, parent binary, role string, text string, last boolean")


def _tokenized(nodes: DataFrame, path: str) -> DataFrame:
    """(node, parent, times, ids, n_tokens, loss_from, loss_to): a turn's three parts are encoded each by itself, so that
    the loss covers whole tokens."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = _tokenizer(path).encode_batch
        for batch in batches:
            parts = [formatted(r, t) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            ids = [[np.array(x.ids, "<u4") for x in encode([p[k] for p in parts], add_special_tokens=False)] for k in range(3)]
            sizes = np.array([[len(x) for x in part] for part in ids], np.int64).reshape(3, -1)
            trained = np.array([r == TRAINED_ROLE for r in batch.column(3).to_pylist()], bool)
            whole = [np.concatenate(x).tobytes() for x in zip(*ids, strict=True)]
            columns = [*(batch.column(k) for k in range(3)), pa.array(whole, pa.binary()), pa.array(sizes.sum(axis=0)), pa.array(sizes[0]), pa.array(np.where(trained, sizes[0] + sizes[1], sizes[0]))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "parent", "times", "ids", "n_tokens", "loss_from", "loss_to"])

    return nodes.select("node", "parent", "times", "role", "text").mapInArrow(run, "node binary, parent binary, times long, ids binary, n_tokens long, loss_from long, loss_to long")


def _segmented(ways: DataFrame) -> DataFrame:
    """(node, segment, path, within, position, n_tokens) of the nodes on ways (conv_id, depth, node, cut, n_tokens): its
    segment's first node, that segment's path at the first node, and the tokens before it there and in all."""
    dealt = ways.repartition(parallelism(ways.sparkSession), "conv_id").sortWithinPartitions("conv_id", "depth")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        path, segment, within, position, cut_before = b"", b"", 0, 0, True
        for batch in batches:
            out = []
            for depth, node, cut, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if not depth:
                    path, position, cut_before = b"", 0, True
                if cut_before:
                    path, segment, within = path + node, node, 0
                out.append((node, segment, None if within else path, within, position, n))
                within, position, cut_before = within + n, position + n, cut
            kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["node", "segment", "path", "within", "position", "n_tokens"])

    return dealt.select("depth", "node", "cut", "n_tokens").mapInArrow(run, "node binary, segment binary, path binary, within long, position long, n_tokens long").dropDuplicates(["node"])


def _placed(segments: DataFrame) -> DataFrame:
    """segments with offset: the tokens of all segments whose path comes before."""
    spark = segments.sparkSession
    dealt = segments.repartitionByRange(parallelism(spark), "path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id())
    ordered = written(dealt, "ordered")
    totals = ordered.groupBy("part").agg(F.sum("length").alias("t"))
    # A row for each task of the sort.
    before = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    own = F.sum("length").over(Window.partitionBy("part").orderBy("path")) - F.col("length")
    return ordered.join(F.broadcast(before), "part").withColumn("offset", F.col("before") + own).drop("part", "before")


def _intervals(parts: str) -> str:
    """SQL of the stretches of parts (k, offset, length), in order, joined where they touch."""
    kind = "array<struct<start:bigint,end:bigint>>"
    touches = "size(acc) > 0 AND element_at(acc, -1).end = x.offset"
    longer = "concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start AS start, x.offset + x.length AS end)))"
    return f"aggregate({parts}, CAST(array() AS {kind}), (acc, x) -> CASE WHEN {touches} THEN {longer} ELSE concat(acc, array(struct(x.offset AS start, x.offset + x.length AS end))) END)"


def build(conversations: DataFrame, path: str) -> Tree:
    """Writes the tree of conversations (conv_id, turn, role, text), with the tokens of the tokenizer at path."""
    chain = written(_chained(conversations), "turns", "zstd")
    nodes = chain.groupBy("node").agg(F.first("parent").alias("parent"), F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("times"))
    tokenized = written(_tokenized(nodes, path), "node-tokens", "zstd")
    ends = written(chain.filter("last").groupBy("node").agg(F.min("conv_id").alias("conv_id")), "ends")
    children = tokenized.groupBy("parent").agg(F.count("*").alias("children")).withColumnRenamed("parent", "node")
    flags = tokenized.select("node", "n_tokens").join(children, "node", "left").join(ends.select("node", F.lit(True).alias("ends")), "node", "left")
    flags = written(flags.select("node", "n_tokens", (F.coalesce("ends", F.lit(False)) | (F.coalesce("children", F.lit(0)) != 1)).alias("cut")), "flags")
    # One conversation of each kind of copies goes the way.
    chosen = chain.select("conv_id", "depth", "node").join(ends.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    ways = join_counted(chosen, flags, ["node"], HOT_ROWS).select("conv_id", "depth", "node", "cut", "n_tokens")
    own = written(_segmented(ways), "segmented")

    whole = own.groupBy("segment").agg(F.max("path").alias("path"), F.sum("n_tokens").alias("length"), F.min("position").alias("position"))
    placed = written(_placed(whole), "placed")
    steps = F.expr(f"transform(sequence(0, octet_length(path) div {NODE_BYTES} - 2), k -> substring(path, k * {NODE_BYTES} + 1, {NODE_BYTES}))")
    above = placed.filter(f"octet_length(path) > {NODE_BYTES}").select(F.col("segment").alias("_own"), F.posexplode(steps).alias("k", "segment"))
    met = join_counted(above, placed.select("segment", "offset", "length"), ["segment"], HOT_ROWS)
    parts = met.groupBy("_own").agg(F.array_sort(F.collect_list(F.struct("k", "offset", "length"))).alias("_parts"))
    ranged = placed.join(parts, F.col("segment") == F.col("_own"), "left").withColumn("_parts", F.coalesce("_parts", F.array().cast("array<struct<k:int,offset:bigint,length:bigint>>")))
    segments = ranged.select(F.col("offset").alias("segment"), "length", "position", F.transform("_parts", lambda x: x["offset"]).alias("ancestors"), F.expr(_intervals("_parts")).alias("intervals"))

    named = join_counted(own.select("node", "segment", "within", "position"), placed.select("segment", "offset"), ["segment"], HOT_ROWS).drop("segment").withColumnRenamed("offset", "segment")
    rows = named.join(tokenized, "node").select((F.col("segment") + F.col("within")).alias("offset"), "position", "segment", "n_tokens", "ids", "loss_from", "loss_to")
    stream = rows.repartitionByRange(parallelism(chain.sparkSession), "offset").sortWithinPartitions("offset")
    of = join_counted(chain.filter("last").select("conv_id", "node"), named.select("node", "segment"), ["node"], HOT_ROWS).select("conv_id", "segment")
    return Tree(written(stream, "stream", "zstd"), written(segments, "segments"), written(of, "conversations"))


def read(tree: Tree, path: str) -> DataFrame:
    """(segment, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each segment that ends a conversation,
    from the stream: the tokens of its ancestors and its own, in order, decoded, parsed and unescaped."""
    ends = tree.conversations.select("segment").distinct().join(tree.segments, "segment")
    wanted = written(ends.select(F.col("segment").alias("end"), F.explode(F.concat("ancestors", F.array("segment"))).alias("segment")), "wanted")
    # A segment that many conversations begin with is laid out several times, and each of them takes one.
    counts = wanted.groupBy("segment").agg(F.count("*").alias("times"))
    often = max(HOT_ROWS, wanted.count() // HOT_PARTS)
    copies = F.broadcast(written(counts.filter(F.col("times") >= often).select("segment", F.ceil(F.col("times") / often).alias("copies")), "copies"))
    salted = lambda rows: rows.join(copies, "segment", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    taken = salted(wanted).withColumn("copy", F.pmod(F.xxhash64("end"), "copies")).drop("copies")
    laid = salted(tree.stream.select("segment", "offset", "ids", "loss_from", "loss_to")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    turns = taken.join(laid, ["segment", "copy"]).select("end", "offset", "ids", "loss_from", "loss_to")
    dealt = turns.repartition(parallelism(wanted.sparkSession), "end").sortWithinPartitions("end", "offset").drop("offset")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decode = _tokenizer(path).decode_batch
        key, n, chars, lost, turns_hash, loss_hash = None, 0, 0, 0, None, None
        names = ["segment", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def told(rows: list[tuple]):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            out = []
            ids = [np.frombuffer(x, "<u4").tolist() for x in batch.column(1).to_pylist()]
            loss = [x[a:b] for x, a, b in zip(ids, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            texts, under = (decode(x, skip_special_tokens=False) for x in (ids, loss))
            for end, text, trained in zip(batch.column(0).to_pylist(), texts, under, strict=True):
                if end != key:
                    if key is not None:
                        out.append((key, n, turns_hash.hexdigest(), lost, loss_hash.hexdigest(), chars))
                    key, n, chars, lost, turns_hash, loss_hash = end, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, said = parsed(text)
                trained = unescape(trained)
                n, chars, lost = n + 1, chars + len(text), lost + len(trained)
                turns_hash.update(f"{role}\n{said}\n".encode())
                loss_hash.update(trained.encode())
            yield told(out)
        if key is not None:
            yield told([(key, n, turns_hash.hexdigest(), lost, loss_hash.hexdigest(), chars)])

    return dealt.mapInArrow(run, "segment long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digest(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the written tree."""
    path = path or vocabulary_path(VOCABULARY)
    tree = build(conversations, path)
    found = written(read(tree, path), "read-back")
    return join_counted(tree.conversations, found, ["segment"], HOT_ROWS).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: A text that holds the template's own marks.
PROBE = "\\### Assistant: </turn> ok"


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conversations and one more, -7, both of whose turns say PROBE."""
    own = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(own)
