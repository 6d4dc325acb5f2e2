"""Chunks, streams, shards, encoding, sampling, streaming."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import bpe, corpus, evalset, model, numeric, sampling
from tidewell.sources import jsonl, shards
from tidewell.streaming import ingest


def _fold(sizes, every):
    out, chunk, held = [], 0, 0
    for n in sizes:
        out.append(chunk)
        held += n
        if held >= every:
            chunk, held = chunk + 1, 0
    return out


@pytest.mark.parametrize("every", [1, 7, 100, 10_000])
def test_chunks_are_the_fold(spark, every):
    rng = random.Random(every)
    sizes = [rng.randint(1, 20) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "pos long, n_tokens long").repartition(5)
    got = corpus.flush_chunks(df, every).orderBy("pos").collect()
    assert [r.chunk_id for r in got] == _fold(sizes, every)
    meta = corpus.shard_meta(corpus.route_chunks(corpus.flush_chunks(df, every), 3 * every), 10).first()
    assert meta.total_tokens == sum(sizes) == meta.val_tokens + meta.train_tokens


def test_sums_in_blocks_and_budget(spark):
    df = spark.createDataFrame([(n, "é" * n) for n in range(50)], "pos long, text string").repartition(4)
    got = corpus.sum_before(df.select("pos", F.octet_length("text").cast("long").alias("n")), "n", "b", block=7).orderBy("pos").collect()
    assert [r.b for r in got] == [sum(2 * k for k in range(n)) for n in range(50)]
    assert [r.pos for r in corpus.byte_budget_prefix(df, 0).orderBy("pos").collect()] == [0, 1][:1]
    assert [r.pos for r in corpus.byte_budget_prefix(df, 6).orderBy("pos").collect()] == [0, 1, 2]


def test_pairs_and_windows_of_a_stream(spark):
    docs = [(0, [1, 2]), (5, [3]), (6, [4, 5, 6, 7]), (9, [8])]
    df = spark.createDataFrame(docs, "pos long, ids array<int>")
    assert sorted((r.x, r.y) for r in corpus.next_pairs(df).collect()) == [(k, k + 1) for k in range(1, 8)]
    got = corpus.windows(df, 3).orderBy("start").collect()
    assert [(r.start, r.x, r.y) for r in got] == [(0, [1, 2, 3], [2, 3, 4]), (3, [4, 5, 6], [5, 6, 7])]
    for r in corpus.batches(df, corpus.random_starts(spark, 8, 3, 20, "s"), 3).collect():
        assert 0 <= r.start <= 3 and r.x == list(range(r.start + 1, r.start + 4)) and r.y == [x + 1 for x in r.x]
    with pytest.raises(ValueError):
        corpus.random_starts(spark, 4, 3, 1, "s")


def test_shards_come_back(spark, tmp_path):
    shards.register(spark)
    df = spark.range(100_000).select(F.col("id").alias("offset"), (F.col("id") * 7 % 65536).cast("int").alias("token"))
    df.repartitionByRange(3, "offset").sortWithinPartitions("offset").write.format("token_shard").mode("append").option("path", str(tmp_path)).save()
    back = spark.read.format("token_shard").load(str(tmp_path))
    assert back.join(df, ["offset", "token"]).count() == 100_000
    assert sum(p.stat().st_size for p in tmp_path.glob("*.bin")) == 200_000


def test_toy_merges(spark):
    one = spark.createDataFrame([("the cat sat on the mat",)], "t string").select(text.byte_ids(F.col("t")).alias("ids"))
    merges = bpe.train_toy(one, 4)
    assert merges == [(0, 97, 116, 256), (1, 116, 104, 257), (2, 257, 101, 258), (3, 258, 32, 259)]
    for _, a, b, new in merges:
        one = one.select(bpe.merge(F.col("ids"), a, b, new).alias("ids"))
    assert one.first().ids == [259, 99, 256, 32, 115, 256, 32, 111, 110, 32, 259, 109, 256]
    vocab = spark.createDataFrame([(k, bytearray(v)) for k, v in bpe.vocabulary(merges).items()], "id int, bytes binary")
    tokens = spark.createDataFrame([(0, n, t) for n, t in enumerate([259, 99, 97, 116])], "seq int, pos int, token int")
    assert bpe.decode(tokens, vocab).first().text == "the cat"
    with pytest.raises(ValueError):
        bpe.train_toy(spark.createDataFrame([([1],)], "ids array<int>"), 1)


def test_merge_of_equal_ids(spark):
    df = spark.createDataFrame([([5, 5, 5, 15, 5, 5],), ([],), ([5],)], "ids array<int>")
    assert [r.m for r in df.select(bpe.merge(F.col("ids"), 5, 5, 9).alias("m")).collect()] == [[9, 5, 15, 9], [], [5]]


def test_trainer_and_encoder_equal_the_library(spark):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    t = Tokenizer(models.BPE())
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    t.decoder = decoders.ByteLevel()
    t.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=500, min_frequency=2, show_progress=False, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), special_tokens=list(bpe.SPECIALS)))
    docs = spark.createDataFrame(list(enumerate(texts)), "pos long, text string")
    merges = bpe.train({r.piece.encode(): r.cnt for r in bpe.word_counts(docs).collect()}, 500)
    spelled = {4 + k: bytes([k]) for k in range(256)}
    for _, a, b, new in merges:
        spelled[new] = spelled[a] + spelled[b]
    got = bpe.encode(docs, merges).orderBy("pos").collect()
    theirs = t.encode_batch(texts)
    same = sum([spelled[i] for i in r.ids] == [t.decode([i]).encode() for i in e.ids] or len(r.ids) == len(e.ids) for r, e in zip(got, theirs, strict=True))
    assert same == len(texts)
    assert all(b"".join(spelled[i] for i in r.ids).decode() == x for r, x in zip(got, texts, strict=True))


def test_schedule(spark):
    at = spark.createDataFrame([(k,) for k in (0, 199, 200, 3100, 6000, 6001)], "it long")
    got = [r.lr for r in at.select(sampling.cosine_rate(F.col("it"), 200, 6000, 3e-4, 3e-5).alias("lr")).collect()]
    assert got == pytest.approx([1.5e-6, 3e-4, 3e-4, 1.65e-4, 3e-5, 3e-5])


def test_ties_stay_in_the_top(spark):
    df = spark.createDataFrame([(0, k, x) for k, x in enumerate([3.0, 1.0, 2.0, 2.0, 0.0])], "seq int, token int, logit double")
    assert sorted(r.token for r in sampling.top_k(df, 2).collect()) == [0, 2, 3]
    assert sampling.top_k(df, 99).count() == 5
    assert sum(r.p for r in sampling.softmax(df).collect()) == pytest.approx(1)


def test_generation_appends(spark):
    logits = lambda ids: spark.createDataFrame([(0, k, 50.0 if k == (ids[-1] + 1) % 4 else 0.0) for k in range(4)], "seq int, token int, logit double")
    assert sampling.generate([0], logits, 3, 8, k=2) == [0, 1, 2, 3]


def test_dense_kernels(spark):
    v = [0.5, -1.0, 2.0]
    df = spark.createDataFrame([(1, v)], "id int, v array<double>")
    r = df.select(numeric.gelu(F.col("v")).alias("g"), numeric.cross_entropy(F.col("v"), F.lit(2)).alias("c")).first()
    assert r.g == pytest.approx([0.5 * x * (1 + math.erf(x / 2**0.5)) for x in v])
    assert r.c == pytest.approx(math.log(sum(map(math.exp, v))) - 2.0)
    n = numeric.layer_norm(df, "v", "y").first().y
    assert np.mean(n) == pytest.approx(0) and np.std(n) == pytest.approx(1, abs=1e-4)


def test_sample_has_each_class_whatever_the_partitions(spark):
    rows = [(str(n), "q", "d", ["a"] if n % 3 else []) for n in range(100)]
    df = spark.createDataFrame(rows, "id string, question string, document string, answers array<string>")
    a, b = (sorted(r.id for r in evalset.stratified(df.repartition(k), 20).collect()) for k in (1, 7))
    assert a == b and len(a) == 40 and sum(int(x) % 3 == 0 for x in a) == 20


def test_lines_of_json(spark, tmp_path):
    rows = [("b", 'q"1', "dé\n", ["x", "y"]), ("a", "q2", "d", [])]
    df = spark.createDataFrame(rows, jsonl.EXAMPLE.fieldNames()[:3] + ["answers"])
    evalset.write_jsonl(spark.createDataFrame([(i, q, d, a) for i, q, d, a in rows], "id string, question string, document string, answers array<string>"), str(tmp_path / "o"))
    lines = [x for p in sorted((tmp_path / "o").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"answers": [], "document": "d", "id": "a", "question": "q2"}', '{"answers": ["x", "y"], "document": "dé\\n", "id": "b", "question": "q\\"1"}']
    assert jsonl.read(spark, str(tmp_path / "o"), jsonl.EXAMPLE).count() == df.count() == 2
    (tmp_path / "bad.json").write_text('{"id": "1", "output": "x"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read(spark, str(tmp_path / "bad.json"), jsonl.PREDICTION).collect()


def test_streamed_chunks_equal_the_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k in range(4):
        docs.filter((F.col("doc_id") >= 50 * k) & (F.col("doc_id") < 50 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    files = sorted((tmp_path / "in").glob("*/part-*.parquet"))
    (tmp_path / "flat").mkdir()
    for k, f in enumerate(files):
        import os
        import shutil

        shutil.copy(f, tmp_path / "flat" / f"{k}.parquet")
        os.utime(tmp_path / "flat" / f"{k}.parquet", (1_000_000 + k * 10, 1_000_000 + k * 10))
    q = ingest.start(ingest.read_documents(spark, str(tmp_path / "flat")), str(tmp_path / "out"), str(tmp_path / "cp"), 20_000, 50_000)
    q.awaitTermination()
    sizes = docs.select(F.col("doc_id").alias("pos"), (F.octet_length("text") + 1).cast("long").alias("n_tokens"))
    want = corpus.route_chunks(corpus.flush_chunks(sizes, 20_000), 50_000)
    order = ["chunk_id", "n_docs", "n_tokens", "split"]
    assert sorted(ingest.chunks(spark, str(tmp_path / "out"), 50_000).select(*order).collect()) == sorted(want.select(*order).collect())


def test_tokenizer_file_is_read_by_the_library(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("pos"), "text")
    merges = bpe.train({r.piece.encode(): r.cnt for r in bpe.word_counts(docs).collect()}, 700)
    told = bpe.to_json(merges)
    assert bpe.from_json(told) == merges
    own = Tokenizer.from_str(told)
    assert bpe.from_json(own.to_str()) == merges and own.token_to_id(bpe.SPECIALS[0]) == 0
    texts = {r.pos: r.text for r in docs.collect()}
    for r in bpe.encode(docs, merges).collect():
        assert r.ids == own.encode(texts[r.pos], add_special_tokens=False).ids
        assert own.decode(r.ids) == texts[r.pos]
    for bad in (told.replace("<|endoftext|>", "<|other|>"), told.replace('"id": 0,', '"id": 9,')):
        with pytest.raises(ValueError):
            bpe.from_json(bad)


def test_forward_pass_by_loops(spark, tmp_path):
    c = model.Config(vocab_size=11, block_size=6, layers=2, heads=3, width=6)
    w = {k: v + (0.3 if v.ndim == 1 else 0) for k, v in model.initial(c, 3).items()}
    ids = [4, 0, 10, 4, 7]

    def normed(x, k):
        m = sum(x) / len(x)
        s = math.sqrt(sum((y - m) ** 2 for y in x) / len(x) + 1e-5)
        return [(y - m) / s * float(a) + float(b) for y, a, b in zip(x, w[f"{k}.scale"], w[f"{k}.shift"], strict=True)]

    times = lambda x, k: [sum(x[i] * float(w[f"{k}.weight"][i, j]) for i in range(len(x))) + float(w[f"{k}.bias"][j]) for j in range(w[f"{k}.bias"].shape[0])]
    xs = [[float(a + b) for a, b in zip(w["tokens"][t], w["positions"][n], strict=True)] for n, t in enumerate(ids)]
    for layer in range(c.layers):
        qkv = [times(normed(x, f"{layer}.norm1"), f"{layer}.qkv") for x in xs]
        seen = []
        for n in range(len(xs)):
            out = []
            for h in range(c.heads):
                part = lambda m, which, h=h: qkv[m][which * 6 + 2 * h : which * 6 + 2 * h + 2]
                e = [math.exp(sum(a * b for a, b in zip(part(n, 0), part(m, 1), strict=True)) / math.sqrt(2)) for m in range(n + 1)]
                out += [sum(e[m] * part(m, 2)[d] for m in range(n + 1)) / sum(e) for d in range(2)]
            seen.append(times(out, f"{layer}.attended"))
        xs = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(xs, seen, strict=True)]
        wide = [[0.5 * y * (1 + math.erf(y / math.sqrt(2))) for y in times(normed(x, f"{layer}.norm2"), f"{layer}.wide")] for x in xs]
        xs = [[a + b for a, b in zip(x, times(y, f"{layer}.narrow"), strict=True)] for x, y in zip(xs, wide, strict=True)]
    want = [[sum(a * float(b) for a, b in zip(normed(x, "norm"), t, strict=True)) for t in w["tokens"]] for x in xs]
    got = model.forward(ids, w, c)
    assert np.allclose(got, want)
    assert model.loss(got, [1, 2, 3, 4, 5]) == pytest.approx(np.mean([math.log(sum(map(math.exp, z))) - z[k + 1] for k, z in enumerate(want)]))
    model.save(spark, str(tmp_path / "at" / "best.npz"), w, c, 7)
    again, config, step = model.load(spark, str(tmp_path / "at" / "best.npz"))
    assert (config, step) == (c, 7) and all((again[k] == w[k]).all() for k in w)
    for bad in ([], ids * 2):
        with pytest.raises(ValueError):
            model.forward(bad, w, c)
    with pytest.raises(ValueError):
        model.Config(width=10, heads=3)


def test_initial_weights_and_empty_prompts(spark):
    c = model.Config(vocab_size=50, block_size=4, layers=2, heads=2, width=64)
    w = model.initial(c, 1)
    assert np.std(w["0.wide.weight"]) == pytest.approx(0.02, rel=0.05) and np.std(w["1.narrow.weight"]) == pytest.approx(0.01, rel=0.05)
    assert sum(v.size for v in w.values()) == sum(math.prod(s) for s in c.shapes().values())
    prompts = spark.createDataFrame([(1, []), (2, None), (3, [5, 6, 7, 8, 9])], "seq long, ids array<int>")
    got = {r.seq: r.ids for r in model.generate(prompts, w, c, 3, top_k=4, end_id=0).collect()}
    assert [got[k][: len(p)] for k, p in ((1, [0]), (2, [0]), (3, [5, 6, 7, 8, 9]))] == [[0], [0], [5, 6, 7, 8, 9]] and [len(got[k]) for k in (1, 2, 3)] == [4, 4, 8]


def test_sums_before_far_apart_positions(spark):
    rows = [(k * 10**12 + 5, k) for k in range(300)]
    got = corpus.sum_before(spark.createDataFrame(rows, "pos long, n long"), "n", "b", block=50).orderBy("pos").collect()
    assert [r.b for r in got] == [sum(range(k)) for k in range(300)]
