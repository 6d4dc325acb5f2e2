"""Byte-pair encoding without whole tables on the driver or token rows in a shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import connection, differences
from tidewell.functions import text
from tidewell.operators import bpe, bpe_train, corpus
from tidewell.sources import shards


def test_spread_trainer_equals_the_plain_one(spark):
    rng = random.Random(5)
    words = dict(("".join(rng.choices("aab é", k=rng.randint(1, 12))), rng.randint(1, 40)) for _ in range(1500)) | {"a" * 31: 7, "aaaa": 3, "": 9}
    rows = spark.createDataFrame(list(words.items()), "piece string, cnt long").repartition(4)
    for size, least in ((300, 2), (600, 500)):
        want = bpe.train({w.encode(): n for w, n in words.items()}, size, least)
        assert bpe_train.train_spread(rows, size, least, ahead=8) == want
        assert want
    assert bpe_train.train_spread(rows.limit(0), 300) == []


def test_many_pieces_are_not_trained_on_the_driver(spark, monkeypatch):
    def never(*args):
        raise AssertionError("all pieces on the driver")

    monkeypatch.setattr(bpe_train, "FEW_PIECES", 10)
    monkeypatch.setattr(bpe_train, "train", never)
    monkeypatch.setattr(bpe, "train", never)
    assert differences(spark, connection(SMALL), SMALL, entry.queries()["bpe_train"], entry.oracle_sql()["bpe_train"]) == []


def _arrays(spark):
    rng = random.Random(8)
    rows = [(k, [rng.randrange(0, 6) for _ in range(rng.choice([0, 0, 1, 2, 30]))]) for k in range(300)] + [(900, None), (901, [7] * 500), (902, [2**31 - 1, -1, -1, 3, 2**31 - 1, -1])]
    return spark.createDataFrame(rows, "seq int, ids array<int>").repartition(3)


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_arrays_are_counted_and_decoded_as_token_rows_are(spark, at_once):
    arrays = _arrays(spark)
    tokens = arrays.select("seq", F.posexplode("ids").alias("pos", "token"))
    order = ["a", "b"]
    assert bpe.pair_counts_of(arrays, at_once).orderBy(*order).collect() == bpe.pair_counts(tokens).orderBy(*order).collect()
    vocab = {0: b"x", 1: b"", 2: "é".encode(), 3: b"yz", 5: b" "}
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in vocab.items()], "id int, bytes binary")
    want = {r.seq: r.text for r in bpe.decode(tokens, table).collect()}
    got = bpe.decode_arrays(arrays.select("ids", "seq"), vocab, at_once).collect()
    assert {r.seq: r.text for r in got} == {k: want.get(k, "") for k in range(300)} | {900: None, 901: "", 902: "yz"}


@pytest.mark.parametrize("name", ["bpe_decode", "pair_counts", "best_pair", "tokenizer_roundtrip"])
def test_no_token_rows_are_shuffled(spark, monkeypatch, name):
    monkeypatch.setattr(bpe, "pair_counts", None)
    monkeypatch.setattr(bpe, "decode", None)
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "Window" not in plan and "Join" not in plan


def test_shards_are_written_from_texts_shuffled_once(spark, tmp_path):
    """Documents are dealt as texts, in an order that shards keep, and not as token rows."""
    shards.register(spark)
    rng = random.Random(3)
    rows = [(k * rng.choice([1, 1, 7]) - 50 + 1000 * k, None if k % 13 == 5 else "".join(rng.choices("abé", k=rng.randint(0, 40)))) for k in range(500)]
    docs = spark.createDataFrame(rows, "pos long, text string").repartition(6)
    want = [b for _, t in sorted(rows) if t is not None for b in [*t.encode(), 0]]
    stream = corpus.ordered_stream(docs, F.octet_length("text") + 1, lambda t: corpus.append_end(text.byte_ids(t)), 5, block=16)
    plan = stream._jdf.queryExecution().executedPlan().toString().split("rangepartitioning")
    assert len(plan) == 2 and "Generate" in plan[0] and "SortMergeJoin" not in plan[0] + plan[1] and "hashpartitioning(pos" not in plan[1]
    stream.write.format("token_shard").mode("append").option("path", f"file:{tmp_path}/s").save()
    got = spark.read.format("token_shard").load(f"file:{tmp_path}/s").orderBy("offset").collect()
    assert [r.offset for r in got] == list(range(len(want))) and [r.token for r in got] == want
    assert len(shards.shard_files(f"file:{tmp_path}/s")) > 2


def test_preview_sends_the_driver_no_more_than_it_keeps(spark):
    """Not the first rows of every task, and not all of many pieces with one count."""
    even = spark.range(0, 5000, 1, 50).select(F.concat(F.lit("p"), "id").alias("piece"), F.lit(1).cast("long").alias("cnt"))
    steep = spark.range(0, 5000, 1, 50).select(F.concat(F.lit("p"), "id").alias("piece"), (F.col("id") * F.col("id") + 1).alias("cnt"))
    for words in (even, steep):
        found = bpe_train._preview(words, 500)
        assert "TakeOrdered" not in found._jdf.queryExecution().executedPlan().toString()
        assert 350 < found.count() < 650
    assert found.agg(F.min("cnt")).first()[0] > 4300**2
    assert bpe_train._preview(steep, 10_000).count() == 5000 and bpe_train._preview(even.limit(0), 10).count() == 0


def test_pieces_encoded_together_equal_pieces_encoded_one_by_one():
    import pyarrow as pa

    rng = random.Random(4)
    words = ["".join(rng.choices("aab\u00e9 ", k=rng.choice([0, 1, 2, 3, 9, 40, 200]))).encode() for _ in range(600)] + [b"a" * n for n in (1, 2, 3, 7, 64, 65, 129)]
    for size in (260, 263, 330):
        merges = bpe.train({w: 1 for w in words}, size)
        ranks = {(a, b): (rank, new) for rank, a, b, new in merges}
        want = [bpe.encode_word(w, ranks) for w in words]
        ids, sizes = bpe.Merges(merges, len(bpe.SPECIALS)).encode(pa.array([b"x", *words], pa.binary()).slice(1))
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize(("stretches", "ahead"), [(1, 3), (30, 16), (100_000, 256)])
def test_rounds_of_any_size_learn_what_one_merge_after_another_does(spark, monkeypatch, stretches, ahead):
    """Ties of many pairs, runs of one id and pieces that differ in length; rounds of a pair alone where the driver may hold nothing."""
    monkeypatch.setattr(bpe_train, "STRETCHES", stretches)
    monkeypatch.setattr(bpe_train, "BLOCK_IDS", 400)
    monkeypatch.setattr(bpe_train, "HELD", 50)
    rng = random.Random(11)
    words = dict(("".join(rng.choices("aaabcd", k=rng.randint(1, 9))), rng.choice([1, 1, 2, 30])) for _ in range(200)) | {"a" * 90: 1, "xyz": 5, "xyzx": 5}
    rows = spark.createDataFrame(list(words.items()), "piece string, cnt long").repartition(2)
    size = 272 if stretches < 100 else 400
    want = bpe.train({w.encode(): n for w, n in words.items()}, size)
    assert bpe_train.train_spread(rows, size, ahead=ahead) == want
    assert len(want) > 10


def test_first_pairs_are_those_before_all_others(spark):
    keys = [(a << 16 | b, n) for a, b, n in [(5, 6, 9), (5, 7, 4), (9, 1, 4), *[(k, j, 3) for k in (8, 4) for j in range(6)], (1, 1, 2)]]
    pairs, order = spark.createDataFrame(keys, "key long, n long"), sorted(keys, key=lambda x: (-x[1], x[0]))
    for rows in (pairs, pairs.filter("n = 3")):
        own = [k for k, n in order if n == 3 or rows is pairs]
        for most in (1, 2, 3, 4, 8, 15, 40):
            found, (n, (a, b)) = bpe_train._first(rows, most, 2)
            assert 1 <= len(found) <= most and set(found) == set(own[: len(found)])
            assert all((-dict(keys)[k], (k >> 16, k & 0xFFFF)) > (n, (a, b)) for k in own[len(found) :])
    assert bpe_train._first(pairs.limit(0), 5, 2)[0] == []


def test_the_whole_vocabulary_is_learnt_from_all_texts(spark, monkeypatch):
    """Not a small part of the reference's 32,768 ids, and not from the first texts alone."""
    from tidewell.plans import corpus_queries
    from tidewell.plans import fixtures as fx

    monkeypatch.setattr(corpus_queries, "TRAINED_BYTES", 10_000)
    words = {r.piece.encode(): r.cnt for r in bpe.word_counts(fx.docs(spark, SMALL)).collect()}
    want = bpe.train(words, 32768)
    assert sorted(map(tuple, entry.queries()["bpe_train"](spark, SMALL).collect())) == want
    assert len(want) > 10_000
