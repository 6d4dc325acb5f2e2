"""Corpus preparation: budgets, chunks, routing and token windows.

Order is explicit: ``pos``.  Running sums are taken in blocks of positions, so no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.operators import fill
from tidewell.operators.fill import BLOCK


def _before(df: DataFrame, value: str, name: str, pos: str, block: int, gathered: Callable, joined: Callable) -> DataFrame:
    """Adds what gathered makes of value over all earlier positions; joined merges the blocks' part and the block's own.

    Positions are cut into ranges of one width, as many as give each some block rows if positions lie evenly, however
    far apart; only one row a range is ordered in one task.
    """
    seen = df.agg(F.min(pos).alias("low"), F.max(pos).alias("high"), F.count("*").alias("n"))
    width = seen.select(F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / block))).alias("width"))
    df = df.withColumn("_block", F.floor(F.col(pos) / width.scalar()))
    totals = df.groupBy("_block").agg(gathered(value).alias("_t"))
    before = totals.select("_block", gathered("_t").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = gathered(value).over(Window.partitionBy("_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    return df.join(before, "_block").withColumn(name, joined(F.col("_before"), own)).drop("_block", "_before")


def sum_before(df: DataFrame, value: str, name: str, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Adds the sum of value over all earlier positions, 0 at the first."""
    return _before(df, value, name, pos, block, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def min_before(df: DataFrame, value: str, name: str, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Adds the least value over all earlier positions, null at the first; nulls are passed over."""
    return _before(df, value, name, pos, block, F.min, F.least)


def blocked(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, block_bytes_before, pos, text, first) of docs (pos, text): blocks of positions, the bytes of all texts before each,
    and whether a document is the first of all.  Blocks come by position alone, so no text is moved."""
    seen = docs.agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("n"))
    width = seen.select(F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / block))).alias("width"))
    rows = docs.select(F.floor(F.col("pos") / width.scalar()).alias("block"), "pos", "text")
    totals = rows.groupBy("block").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("t"))
    before = totals.select("block", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("block_bytes_before"))
    # One row a block is broadcast: text_within() then deals the rows out itself, and no join on block passes for that.
    return rows.join(F.broadcast(before), "block").select("block", "block_bytes_before", "pos", "text", F.coalesce(F.col("pos") == seen.select("low").scalar(), F.lit(False)).alias("first"))


def byte_budget_prefix(docs: DataFrame, budget: int) -> DataFrame:
    """(pos, n_bytes, bytes_before) of the documents up to the one that reaches the budget; the first always."""
    sized = docs.select("pos", F.octet_length("text").cast("long").alias("n_bytes"))
    summed = sum_before(sized, "n_bytes", "bytes_before")
    first = sized.agg(F.min("pos").alias("first"))
    return summed.filter((F.col("bytes_before") < budget) | (F.col("pos") == first.scalar()))


def flush_chunks(sizes: DataFrame, flush_every: int) -> DataFrame:
    """(pos, n_tokens, chunk_id, full): whole documents fill a chunk until it holds flush_every tokens."""
    full = F.sum("n_tokens").over(Window.partitionBy("chunk_id")) >= flush_every
    return fill.chunk_ids(sizes, flush_every).withColumn("full", full)


def route_chunks(chunked: DataFrame, val_tokens: int) -> DataFrame:
    """(chunk_id, n_docs, n_tokens, split): full chunks are validation while less than val_tokens went there before."""
    chunks = chunked.groupBy("chunk_id").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.bool_and("full").alias("full"))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Every chunk before the first of training is validation, so what went there is the plain running sum.
    return chunks.select("chunk_id", "n_docs", "n_tokens", F.when(F.col("full") & (before < val_tokens), "val").otherwise("train").alias("split"))


def shard_meta(routed: DataFrame, vocab_size: int) -> DataFrame:
    total = F.coalesce(F.sum("n_tokens"), F.lit(0))
    val = F.coalesce(F.sum(F.when(F.col("split") == "val", F.col("n_tokens"))), F.lit(0))
    return routed.agg(total.alias("total_tokens"), val.alias("val_tokens"), (total - val).alias("train_tokens"), F.lit(vocab_size).cast("long").alias("vocab_size"), F.lit("uint16").alias("dtype"))


def append_end(ids: Column, end_id: int = 0) -> Column:
    return F.concat(ids, F.array(F.lit(end_id).cast("int")))


def placed(ids: DataFrame) -> DataFrame:
    """(pos, before, n): where each document (pos, ids) stands in the stream of all, and its size."""
    return sum_before(ids.select("pos", F.size("ids").cast("long").alias("n")), "n", "before").select("pos", "before", "n")


def token_stream(ids: DataFrame) -> DataFrame:
    """(offset, token) of documents (pos, ids), one after another."""
    rows = ids.join(placed(ids).select("pos", "before"), "pos").select("before", F.posexplode("ids").alias("k", "token"))
    return rows.select((F.col("before") + F.col("k")).alias("offset"), "token")


#: Documents of a block that is one task's at least, where a stream is written.
STREAM_BLOCK = 2_000


def ordered_stream(docs: DataFrame, size: Column, ids: Callable[[Column], Column], parts: int, block: int = STREAM_BLOCK) -> DataFrame:
    """(offset, token) of documents (pos, text), one after another, in parts that follow each other, sorted within them.

    Documents travel once, as their texts, and become ids where they are needed: blocks of positions are dealt by range,
    a window sums up the sizes within each, and what is before a block is broadcast, one row each.
    """
    seen = docs.agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("n"))
    width = seen.select(F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / block))).alias("width"))
    rows = docs.select(F.floor(F.col("pos") / width.scalar()).alias("_block"), "pos", "text", F.coalesce(size, F.lit(0)).cast("long").alias("_n"))
    totals = rows.groupBy("_block").agg(F.sum("_n").alias("_t"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_block", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    dealt = rows.join(F.broadcast(before), "_block").repartitionByRange(parts, "_block").sortWithinPartitions("_block", "pos")
    own = F.coalesce(F.sum("_n").over(Window.partitionBy("_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed_ = dealt.select((F.col("_before") + own).alias("_at"), "text")
    return placed_.select("_at", F.posexplode(ids(F.col("text"))).alias("k", "token")).select((F.col("_at") + F.col("k")).alias("offset"), "token")


def next_pairs(ids: DataFrame) -> DataFrame:
    """(x, y) of all neighbours in the stream of documents (pos, ids), none of them empty, across their borders too."""
    heads = sum_before(ids.select("pos", F.lit(1).cast("long").alias("one"), F.col("ids")[0].alias("head")), "one", "k")
    after = heads.select((F.col("k") - 1).alias("k"), F.col("head").alias("next"))
    ends = heads.join(after, "k", "left").select("pos", "next")
    moved = F.concat(F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0))), F.array("next"))
    pairs = ids.join(ends, "pos").select(F.explode(F.zip_with("ids", moved, lambda a, b: F.struct(a.alias("x"), b.alias("y")))).alias("p"))
    return pairs.select("p.x", "p.y").filter("y IS NOT NULL")


def _joined(pieces: DataFrame, keys: list[str], length: int) -> DataFrame:
    """keys, start, x, y of pieces (keys, start, at, ids) that make up length + 1 tokens each; shorter ones go."""
    whole = pieces.groupBy(*keys, "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda p: p["ids"])).cast("array<long>").alias("t"))
    return whole.filter(F.size("t") == length + 1).select(*keys, "start", F.slice("t", 1, length).alias("x"), F.slice("t", 2, length).alias("y"))


def _piece(start: Column, length: int) -> list[Column]:
    """What a document (before, n, ids) has of the length + 1 tokens from start: its place, and the ids."""
    at = F.greatest(start, F.col("before"))
    end = F.least(start + length + 1, F.col("before") + F.col("n"))
    return [at.alias("at"), F.slice("ids", (at - F.col("before") + 1).cast("int"), (end - at).cast("int")).alias("ids")]


def windows(ids: DataFrame, length: int) -> DataFrame:
    """(start, x, y): consecutive whole windows of the stream of documents (pos, ids), y one place later.

    Each document is cut at the windows' borders, so a window gathers some arrays and not its tokens one by one; a
    piece has one token of the next window, for y.
    """
    rows = ids.join(placed(ids), "pos").filter("n > 0")
    first = F.greatest(F.lit(0), F.floor((F.col("before") - 1) / length))
    last = F.floor((F.col("before") + F.col("n") - 1) / length)
    cut = rows.select("before", "n", "ids", F.explode(F.sequence(first, last)).alias("w")).withColumn("start", F.col("w") * length)
    return _joined(cut.select("start", *_piece(F.col("start"), length)), [], length)


def random_starts(spark, n_tokens: int, length: int, batch: int, seed: str) -> DataFrame:
    """(i, start): batch starts with replacement, from 0 to n_tokens - length - 2, by a hash of seed and i."""
    if n_tokens - length - 1 <= 0:
        raise ValueError("the shard is shorter than a window")
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    return spark.range(batch).select(F.col("id").alias("i"), F.pmod(drawn, F.lit(n_tokens - length - 1)).alias("start"))


def batches(ids: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """(i, start, x, y) of the windows at the drawn starts in the stream of documents (pos, ids).

    The starts are one batch, whose size is a parameter, so they are sent to the documents' places; only documents
    that a window meets are read whole.
    """
    meets = (F.col("before") <= F.col("start") + length) & (F.col("before") + F.col("n") > F.col("start"))
    met = placed(ids).join(F.broadcast(starts), meets)
    return _joined(met.join(ids, "pos").select("i", "start", *_piece(F.col("start"), length)), ["i"], length)
