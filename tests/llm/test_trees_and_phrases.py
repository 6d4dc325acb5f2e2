"""Chat trees, whitening and phrases: brute force, round trips and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewell.llm import chat_tree, phrases, queries, whitening
from tidewell.llm.encoding import vocabulary_path

CLASHES = ("node", "segment", "path", "n", "end", "w", "v", "key", "bucket", "score", "depth", "copies", "_k")
PATH = vocabulary_path(chat_tree.VOCABULARY)


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


# --- chat ---


def brute_chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        size = sum(len("".join(chat_tree.formatted(r, t))) for _, _, r, t in turns)
        out.add((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return out


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "#### </turn> <|endoftext|> \\# <\\|\n"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (2, 2, "user", "x"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "other"), (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
    (None, None, None, None), (None, 1, "a:\nb", "é\u2028  \x00x"), (5, 0, None, ""), (5, 0, None, ""), (6, 0, "user", ""), (7, 0, "user", "é" * 50_000),
]
KINDS = "conv_id long, turn long, role string, text string"


def test_chat_reads_back_what_went_in(spark):
    table = chat_tree.with_probe(spark, spark.read.parquet(f"{SMALL}/conversations.parquet"))
    got = [tuple(r) for r in queries.op11_chat_prefix_tree(spark, SMALL).collect()]
    assert set(got) == brute_chat([tuple(r) for r in table.collect()]) and len(got) == len({r[0] for r in got})
    assert {r[0] for r in got} >= {-7}


def test_chat_of_odd_rows(spark):
    df = clashing(spark.createDataFrame(TURNS, KINDS))
    assert {tuple(r) for r in chat_tree.digest(df).collect()} == brute_chat(TURNS)
    assert chat_tree.digest(df.filter("conv_id > 100")).count() == 0


def test_shared_turns_are_emitted_once_depth_first(spark):
    rng = random.Random(4)
    rows = [(c, t, "assistant" if t % 2 else "user", rng.choice("ab")) for c in range(60) for t in range(rng.randint(1, 5))]
    tree = chat_tree.build(spark.createDataFrame(rows, KINDS), PATH)
    stream = tree.stream.orderBy("offset").collect()
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((role, text))
    assert len(stream) == len({tuple(v[:k]) for v in by.values() for k in range(1, len(v) + 1)})
    # Offsets are gapless, position ids go on from the ancestors, and the intervals are the ancestors' tokens.
    assert [r.offset for r in stream] == [sum(x.n_tokens for x in stream[:k]) for k in range(len(stream))]
    segments = {r.segment: r for r in tree.segments.collect()}
    decode = chat_tree._tokenizer(PATH).decode
    for s in segments.values():
        seen = [r for r in stream if any(i.start <= r.offset < i.end for i in s.intervals)]
        assert sum(r.n_tokens for r in seen) == s.position == sum(segments[a].length for a in s.ancestors)
        assert all(a.end < b.start for a, b in zip(s.intervals, s.intervals[1:], strict=False))
        assert s.ancestors == sorted(s.ancestors) and all(a < s.segment for a in s.ancestors)
    ends = {r.conv_id: r.segment for r in tree.conversations.collect()}
    for c, turns in by.items():
        s = segments[ends[c]]
        nodes = [r for r in stream if r.segment == s.segment or r.segment in s.ancestors]
        assert [chat_tree.parsed(decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False)) for r in nodes] == turns
        assert [r.position for r in nodes] == [sum(x.n_tokens for x in nodes[:k]) for k in range(len(nodes))]
    # Depth first: between a segment and the last of its descendants stands nothing else.
    for s in segments.values():
        below = [x.segment for x in segments.values() if s.segment in x.ancestors]
        inside = [x for x in segments if s.segment < x <= max(below, default=s.segment)]
        assert sorted(below) == sorted(inside)


@given(st.text(alphabet="\\#</turn>|:\n aé", max_size=40), st.text(alphabet="\\#</turn>|:\n aé", max_size=20))
@settings(max_examples=400, deadline=None)
def test_template_is_reversible(text, role):
    turn = "".join(chat_tree.formatted(role, text))
    assert chat_tree.parsed(turn) == (role, text)
    assert turn.count("</turn>") == 1 and turn.count("###") == 1 and "<|" not in turn


# --- whitening ---


def brute_whitening(rows):
    kept = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in kept], dtype=object)
    n = len(x)
    z = n * x - x.sum(axis=0)
    centred = z.astype(float) / n
    cov = centred.T @ centred / n
    e, axes = np.linalg.eigh(cov)
    first = np.argsort(-e)[:8]
    return kept, [sum(a * a for a in r) for r in z], centred @ axes[:, first] / np.sqrt(e[first]), e[first] / np.trace(cov)


def test_whitening_equals_a_plain_one(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    kept, deviations, w, share = brute_whitening([(r.vec_id, r.embedding) for r in df.collect()])
    got = defaultdict(dict)
    for r in queries.op12_gramian_whitening(spark, SMALL).collect():
        got[r.vec_id][r.component] = r
    signs = [np.sign(got[kept[0][0]][k + 1].whitened * w[0, k]) for k in range(8)]
    assert len(got) == len(kept)
    for (i, _), deviation, row in zip(kept, deviations, w, strict=True):
        for k in range(8):
            r = got[i][k + 1]
            assert (r.n, r.deviation, r.deviation_exact) == (len(kept), deviation, str(deviation))
            assert r.whitened == pytest.approx(signs[k] * row[k], abs=1e-9) and r.explained == pytest.approx(share[k], rel=1e-9)
            assert r.identity_error < 1e-9


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, 0.25]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, []), (7, [3.0]), (8, [1e300, 0.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (7, 1), (7, 2), (8, 1), (8, 2)]
    assert all(r.deviation is None and int(r.deviation_exact) > 2**63 for r in got)
    alone = whitening.whiten(df.filter("vec_id = 1")).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in alone} == {(0, None, None, None)}
    assert whitening.whiten(df.filter("vec_id > 100")).count() == 0 and whitening.whiten(df.filter("vec_id = 6")).count() == 0


def test_sums_of_squares_are_exact():
    rng = np.random.default_rng(1)
    for most in (10, 2**30, 2**40, 2**50):
        z = rng.integers(-most, most, (20, 64))
        assert whitening._squares(z) == [sum(int(a) ** 2 for a in row) for row in z]
        assert whitening._squares(z.astype(object)) == whitening._squares(z)


# --- phrases ---


def brute_phrases(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        kept = []
        for p, a in found.items():
            if 100 * longest[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def odd_texts():
    rng = random.Random(8)
    words = ["The", "of", "a\x01", "\x00", "é", "x\x0ey", "Q", "zz", "w" * 100, "\u4e2d", "a"]
    rows = [(lang, " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\t", "\n", "!"]) for _ in range(rng.randint(0, 700)))) for lang in (None, "en", "", "a\x00b", "a") for _ in range(40)]
    rows += [("en", "same old story told again. " * 400), ("en", None), ("en", ""), ("en", " \t\n.,"), (None, "the the the the " * 500)]
    return rows


@pytest.mark.parametrize("a_task", [40, 2_500_000])
def test_phrases_equal_brute_force(spark, a_task):
    """Few suffixes a task split nearly all first words, whose counts are then summed."""
    rows = odd_texts()
    df = clashing(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string"))
    got = sorted(tuple(r) for r in phrases.collocations(df, a_task=a_task).collect())
    assert got == brute_phrases(rows) and len(got) > 100
    assert phrases.collocations(df.filter("doc_id < 0")).count() == 0


def test_query_of_phrases_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(tuple(r) for r in queries.op13_suffix_phrases(spark, SMALL).collect()) == brute_phrases([(r.lang, r.text) for r in docs.collect()])


@pytest.mark.parametrize("most", [7, 20, 64, 1000])
def test_long_texts_lose_no_suffix(monkeypatch, most):
    """Whatever the stretches, every word starts one suffix, with the words that follow it in its piece."""
    rng = random.Random(most)
    texts = ["".join(rng.choice(["a", "bb", " ", " ", "\t", ".", "\n", "w" * 30]) for _ in range(rng.randint(0, 300))).encode() for _ in range(30)]

    def told():
        out = Counter()
        for words, own in phrases._stretches(texts):
            for i in range(own):
                if words[i] != b"\n":
                    piece = words[i : i + 4]
                    out[tuple(piece[: piece.index(b"\n")] if b"\n" in piece else piece)] += 1
        return out

    whole = told()
    monkeypatch.setattr(phrases, "STRETCH", most)
    assert told() == whole


def test_codes_go_back(spark):
    rng = random.Random(3)
    words = [f"w{k}".encode() for k in range(3000)]
    codes = phrases.Codes(words)
    for _ in range(2000):
        own = [rng.choice([*words[:1200], b"other", "é".encode(), b"\x00"]) if rng.random() < 0.5 else rng.choice(words) for _ in range(4)]
        coded = [codes.table.get(w) or w + b" " for w in own]
        assert codes.phrase(b"".join(coded)) == b" ".join(own)
        assert codes.ends(b"".join(coded)) == list(np.cumsum([len(c) for c in coded]))


@pytest.mark.parametrize("a_task", [40, 2_500_000])
def test_prefixes_go_on_from_batch_to_batch(spark, monkeypatch, a_task):
    """Whatever the batches of keys, and with languages of long codes beside short ones."""
    rows = odd_texts()
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string")
    monkeypatch.setattr(phrases, "SHORT_LANGUAGES", 2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(tuple(r) for r in phrases.collocations(df, a_task=a_task).collect()) == brute_phrases(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_suffixes_have_no_rare_word_and_two_words(spark):
    rows = [("en", "often here rare%d often here" % k) for k in range(40)] + [("de", "often here")]
    df = spark.createDataFrame(rows, "lang string, text string")
    counts = phrases.word_counts(df)
    codes = phrases.Codes([], ["en"])
    share = spark.sparkContext.broadcast
    found = Counter()
    for r in phrases.suffixes(df, share(codes), share({}), share(phrases._often(counts))).collect():
        found[codes.split(bytes(r.key))[0], bytes(r.key)] += r.n
    assert {k: n for k, n in found.items() if k[0] == "en" and b"rare" not in k[1]} == {("en", b"\x01often here "): 80}
    assert len(found) <= 4  # a bit may be shared


def test_cuts_are_made_once(spark):
    """The counted joins read them from a file, and the left parts' counts too."""
    table = spark.createDataFrame([("en", p, len(p.split()), f) for p, f in (("a b c", 30), ("a b", 40), ("b c", 50), ("a", 60), ("c", 70))], "lang string, phrase string, words int, f long")
    found = phrases.scored(table, table.filter("words = 3").withColumnRenamed("f", "a"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "left_" not in plan and plan.count("LeftAnti") == 1
    assert [tuple(r) for r in found.collect()] == [("en", "a b c", 3, 30, 60, 50, 2_000_000 * 30 // 110)]


def test_phrases_of_split_first_words_are_told_once(spark):
    """No partial counts: what the tasks tell is what is frequent, however many first words are split."""
    rows = [("en", "".join(f"hot w{k % 7} v{k % 90} x{k % 1000} " for k in range(j, j + 300))) for j in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    counts = phrases.word_counts(df)
    share = spark.sparkContext.broadcast
    codes, hot = share(phrases.Codes(phrases._frequent(counts), ["en"])), share({("en", b"hot"): 6, ("en", b"w1"): 4})
    dealt = phrases.suffixes(df, codes, hot, share(phrases._often(counts))).repartition(8, "bucket").select("key", "n").sortWithinPartitions(F.desc("key"))
    got = [(codes.value.phrase(bytes(r.phrase)).decode(), r.n) for r in phrases._prefixes(dealt, codes, hot).collect()]
    want = Counter(" ".join(w[i : i + m]) for w in (t.split() for _, t in rows) for m in (2, 3, 4) for i in range(len(w) - m + 1))
    assert sorted(got) == sorted((p, n) for p, n in want.items() if n >= 30) and got
