"""Special tokens at encoding, filters pushed into shards, the streamed corpus and the table function."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tidewell.functions import tables
from tidewell.operators import bpe, corpus
from tidewell.sources import shards
from tidewell.streaming import corpus_stream

# --- encoding ---


def special_texts():
    rng = random.Random(2)
    parts = [*bpe.SPECIALS, "<|", "|>", "<|pad", " ", "  ", "\n", "12", "a", "the cat", "don't", "é", " ", "中文", "<|endoftext|><|pad|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["", "<|endoftext|>", " <|pad|> ", None]


def test_encoding_special_tokens_as_the_library_does(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("pos"), "text")
    merges = bpe.train({r.piece.encode(): r.cnt for r in bpe.word_counts(docs).collect()}, 500)
    texts = special_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string")
    encoded = bpe.encode(df, merges)
    theirs = Tokenizer.from_str(bpe.to_json(merges))
    for r in encoded.collect():
        assert r.ids == theirs.encode(texts[r.pos] or "", add_special_tokens=False).ids, texts[r.pos]
    assert "Exchange" not in encoded._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert bpe.encode(df.filter("pos < 0"), merges).count() == 0


def test_special_tokens_that_begin_others(spark):
    """The leftmost token, and the longest there."""
    df = spark.createDataFrame([(0, "x<a><a>b<a>"), (1, "<a><a")], "pos long, text string")
    got = {r.pos: r.ids for r in bpe.encode(df, [], ("<a>", "<a>b", "[.*]")).collect()}
    assert got == {0: [3 + ord("x"), 0, 1, 0], 1: [0, 3 + ord("<"), 3 + ord("a")]}


def test_words_are_merged_in_order_of_rank():
    rng = random.Random(6)
    for _ in range(300):
        merges, known = {}, list(range(2, 6))
        for rank in range(rng.randint(0, 12)):
            pair = (rng.choice(known), rng.choice(known))
            if pair not in merges:
                merges[pair] = (rank, 1000 + rank)
                known.append(1000 + rank)
        word = bytes(rng.randint(0, 3) for _ in range(rng.randint(0, 14)))
        ids = [2 + b for b in word]
        while True:  # one rank after another, each from the left
            met = [merges[p] for p in zip(ids, ids[1:], strict=False) if p in merges]
            if not met:
                break
            rank, new = min(met)
            out, k = [], 0
            while k < len(ids):
                hit = k + 1 < len(ids) and merges.get((ids[k], ids[k + 1]), (None,))[0] == rank
                out.append(new if hit else ids[k])
                k += 1 + hit
            ids = out
        assert bpe.encode_word(word, merges, 2) == ids
    assert len(bpe.encode_word(b"ab" * 500_000, {(97 + 4, 98 + 4): (0, 300)})) == 500_000


# --- shards ---


@pytest.fixture(scope="module")
def shard_path(spark, tmp_path_factory):
    shards.register(spark)
    path = f"file:{tmp_path_factory.mktemp('shards')}"
    rows = spark.range(100_000).select(F.col("id").alias("offset"), (F.col("id") % 60_000).cast("int").alias("token"))
    rows.repartitionByRange(4, "offset").sortWithinPartitions("offset").write.format("token_shard").mode("append").option("path", path).save()
    return path


def read_bytes(path, filters):
    reader = shards.Reader(path)
    left = list(reader.pushFilters(filters))
    return left, sum(p.size for r in reader.partitions() for p in r.pieces), reader


def test_a_window_reads_its_own_bytes(spark, shard_path):
    at = ("offset",)
    assert read_bytes(shard_path, [])[1] == 200_000 and shards.total_tokens(shard_path) == 100_000
    assert read_bytes(shard_path, [GreaterThanOrEqual(at, 5_000), LessThan(at, 5_064)])[:2] == ([], 128)
    assert read_bytes(shard_path, [GreaterThan(at, 24_990), LessThanOrEqual(at, 25_010)])[1] == 40  # over two files, or within one
    assert read_bytes(shard_path, [EqualTo(at, 7)])[1] == 2 and read_bytes(shard_path, [EqualTo(at, 10**9)])[1] == 0
    assert read_bytes(shard_path, [In(at, (1, 2, 3, 50_000)), LessThan(at, 3)])[1] == 4
    other = LessThan(("token",), 3)
    assert read_bytes(shard_path, [other])[:2] == ([other], 200_000)


def test_pushed_filters_give_the_same_rows(spark, shard_path):
    rows = spark.read.format("token_shard").load(shard_path)
    for keep in ("offset >= 24990 AND offset < 25020", "offset IN (3, 99999, 60001, 200000)", "offset = 5 AND token = 6", "offset > 99990 AND token < 39995", "offset < 0", "offset IS NULL", "offset <= 3 OR offset = 70000"):
        expected = [(o, o % 60_000) for o in range(100_000)]
        got = sorted(map(tuple, rows.filter(keep).collect()))
        plain = spark.createDataFrame(expected, "offset long, token int").filter(keep)
        assert got == sorted(map(tuple, plain.collect())), keep
    drawn = corpus.random_starts(spark, shards.total_tokens(shard_path), 32, 9, "s")
    for r in shards.windows(spark, shard_path, drawn, 32).collect():
        assert list(r.x) == [o % 60_000 for o in range(r.start, r.start + 32)] and list(r.y) == [o % 60_000 for o in range(r.start + 1, r.start + 33)]


def test_a_commit_that_fails_leaves_the_old_shards(spark, tmp_path):
    shards.register(spark)
    path = f"file:{tmp_path}"
    put = lambda n: spark.range(n).selectExpr("id AS offset", "CAST(1 AS INT) AS token").coalesce(1).write.format("token_shard").mode("overwrite").option("path", path).save()
    put(10)
    with pytest.raises(OSError):
        shards.Writer(path, True).commit([shards.Written(f"{tmp_path}/_gone", 0)])
    assert spark.read.format("token_shard").load(path).count() == 10
    put(3)
    assert spark.read.format("token_shard").load(path).count() == 3 and len([f for f in os.listdir(tmp_path) if f.endswith(".bin")]) == 1


# --- the streamed corpus and the table function ---


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("pos"), "text")


def expected(docs, budget):
    return sorted(map(tuple, corpus.byte_budget_prefix(docs, budget).join(docs, "pos").select("pos", "text", "n_bytes", "bytes_before").collect()))


def test_a_stream_starts_again_where_it_stopped(spark, tmp_path):
    docs, budget = documents(spark), 150_000
    path = f"file:{tmp_path}/corpus"
    corpus_stream.write(docs, path, 10_000)
    args = (f"file:{tmp_path}/out", f"file:{tmp_path}/checkpoint")

    def stream():
        return corpus_stream.read(spark, path, budget, 25_000, f"file:{tmp_path}/progress")

    # Files after the budget are never opened.
    index = spark.read.parquet(f"{path}/_index").collect()
    beyond = {r.file for r in index} - {r.file for r in index if r.text_before < budget}
    assert beyond
    for name in beyond:
        os.remove(f"{tmp_path}/corpus/{name}")
    failing = stream().withColumn("x", F.when(F.col("bytes_before") > 60_000, F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        corpus_stream.ingest(failing, *args)
    done = spark.read.parquet(args[0]).count()
    query = corpus_stream.ingest(stream().withColumn("x", F.lit(None).cast("void").cast("string")), *args)
    assert query.lastProgress is not None and 0 < done
    got = spark.read.schema(corpus_stream.SCHEMA).parquet(args[0]).collect()
    assert sorted(map(tuple, got)) == expected(docs, budget)
    batches = len([f for f in os.listdir(f"{tmp_path}/checkpoint/commits") if not f.startswith(".")])
    assert batches >= 4
    # Nothing is left to read.
    corpus_stream.ingest(stream().withColumn("x", F.lit(None).cast("string")), *args)
    assert spark.read.parquet(args[0]).count() == len(got)


@pytest.mark.parametrize("budget", [-1, 0, 1, 5_000, 10**9])
def test_budgets_by_table_function_and_stream(spark, tmp_path, budget):
    docs = documents(spark)
    want = expected(docs, budget)
    assert sorted(map(tuple, tables.text_within(docs, budget).collect())) == want
    corpus_stream.write(docs, f"file:{tmp_path}/c", 50_000)
    corpus_stream.ingest(corpus_stream.read(spark, f"file:{tmp_path}/c", budget, 10**9, f"file:{tmp_path}/p"), f"file:{tmp_path}/out", f"file:{tmp_path}/k")
    assert sorted(map(tuple, spark.read.schema(corpus_stream.SCHEMA).parquet(f"file:{tmp_path}/out").collect())) == want


def test_table_function_takes_blocks(spark):
    docs = documents(spark)
    tables.register(spark)
    corpus.blocked(docs, 16).createOrReplaceTempView("small_blocks")
    assert spark.table("small_blocks").select("block").distinct().count() > 8
    got = spark.sql("SELECT * FROM text_within(TABLE(small_blocks), 90000)")
    assert sorted(map(tuple, got.collect())) == expected(docs, 90_000)
    with pytest.raises(Exception, match="blocked"):
        spark.sql("SELECT * FROM text_within(TABLE(SELECT 1 AS pos), 5)").collect()
    odd = spark.createDataFrame([(1, None), (2, "é"), (5, ""), (9, "x")], "pos long, text string")
    assert [(r.pos, r.n_bytes, r.bytes_before) for r in tables.text_within(odd, 3).orderBy("pos").collect()] == [(1, 0, 0), (2, 2, 0), (5, 0, 2), (9, 1, 2)]
    assert tables.text_within(odd.filter("pos > 100"), 3).count() == 0


def test_a_block_from_many_files_is_one_part(spark, tmp_path):
    """Adaptive execution split a large block's part of the join on block, and each piece of it began at the block's start."""
    docs = spark.range(4000).select(F.col("id").alias("pos"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    docs.repartitionByRange(6, "pos").write.parquet(f"file:{tmp_path}/docs")
    docs = spark.read.parquet(f"file:{tmp_path}/docs")
    split = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    for k, v in split.items():
        spark.conf.set(k, v)
    try:
        assert docs.rdd.getNumPartitions() > 4
        assert sorted(map(tuple, tables.text_within(docs, 30_000).collect())) == expected(docs, 30_000)
        # The same where a view joins on block itself.
        tables.register(spark)
        blocks = corpus.blocked(docs).drop("block_bytes_before")
        starts = corpus.blocked(docs).groupBy("block").agg(F.min("block_bytes_before").alias("block_bytes_before"))
        blocks.join(starts, "block").createOrReplaceTempView("joined_blocks")
        assert sorted(map(tuple, spark.sql("SELECT * FROM text_within(TABLE(joined_blocks), 30000)").collect())) == expected(docs, 30_000)
    finally:
        for k in split:
            spark.conf.unset(k)
