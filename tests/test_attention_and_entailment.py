"""Attention by tiles, and support of claims by evidence, against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import entailment, numeric

SCHEMA = "seq int, pos int, q array<array<double>>, k array<array<double>>, v array<array<double>>"


def _want(rows, heads, shared):
    out = []
    for seq, pos, q, _, _ in rows:
        seen = [(k, v) for s, p, _, k, v in rows if s == seq and p <= pos]
        for h in range(heads):
            kv = h * shared // heads
            x = np.array([np.dot(q[h], k[kv]) for k, _ in seen]) / math.sqrt(len(q[h]))
            e = np.exp(x - x.max())
            out.append((seq, pos, h, (e[:, None] * np.array([v[kv] for _, v in seen])).sum(axis=0) / e.sum()))
    return sorted(out, key=lambda r: (*r[:3], *r[3]))


@pytest.mark.parametrize(("tile", "strip"), [(1, 1), (3, 2), (64, 16)])
def test_tiles_equal_the_square(spark, tile, strip):
    rng = np.random.default_rng(tile)
    vectors = lambda n: (30 * rng.normal(size=(n, 6))).tolist()  # noqa: E731  large scores, so the maximum matters
    # A long sequence, gaps, a position below zero, a repeated position.
    places = [(1, p) for p in range(23)] + [(2, p) for p in (-5, 0, 4, 4, 90, 1000)] + [(3, 7)]
    rows = [(s, p, vectors(4), vectors(2), vectors(2)) for s, p in places]
    odd = [(None, 1, *rows[0][2:]), (1, None, *rows[0][2:]), (1, 50, None, None, None)]
    got = numeric.grouped_attention(spark.createDataFrame(rows + odd, SCHEMA), tile, strip).collect()
    got = sorted(((r.seq, r.pos, r.head, *r.out) for r in got))
    want = _want(rows, 4, 2)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3:] for g in got], [w[3] for w in want], atol=1e-9)
    assert numeric.grouped_attention(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_row_is_a_pair(spark):
    """128 positions in tiles of 32: ten pairs of tiles, and not 8,256 pairs of positions, leave the join."""
    rows = spark.range(128).select(F.lit(1).alias("seq"), F.col("id").alias("pos"), *[F.array(F.col("id") / 128, F.lit(1.0)).alias(c) for c in "qkv"])
    held = numeric.causal_attention(rows, 32)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "kt" in plan and "kp" not in plan
    out = {r.pos: r.out for r in held.collect()}
    assert len(out) == 128 and all(abs(v[1] - 1) < 1e-12 for v in out.values())


def _score(claim, evidence, corpus):
    df = Counter(w for t in corpus for w in set((t or "").split()))
    c, e = (claim or "").split(), (evidence or "").split()
    if not c:
        return None
    need, m = Counter(c), len(c)
    weight = {w: math.log((len(corpus) + 1) / (df[w] + 1) + 1) for w in need}
    s = max(entailment.BAND, math.ceil(m / 4))
    best = 0.0
    for start in range(0, max(len(e), 1), s):
        have = Counter(e[start : start + m + s])
        best = max(best, sum(min(n, have[w]) * weight[w] for w, n in need.items()))
    return best / sum(n * weight[w] for w, n in need.items())


def test_scores_equal_plain_windows(spark):
    rng = random.Random(5)
    word = lambda: "w" + str(min(rng.randint(0, 400), rng.randint(0, 400)))
    text = lambda n: " ".join(word() for _ in range(n))
    corpus = [text(rng.randint(0, 120)) for _ in range(60)] + [None, ""]
    rows = []
    for k in range(60):
        e = text(rng.randint(0, 300))
        at = rng.randint(0, 200)
        rows.append((k, " ".join(w for w in e.split()[at : at + rng.randint(1, 50)] if rng.random() < 0.8) if k % 2 else text(rng.randint(1, 80)), e))
    rows += [(100, None, "w1"), (101, "", "w1 w2"), (102, "w1 w2", None), (103, "unheard of", "unheard of"), (104, "w1", "w1 " * 20_000), (105, "w1 w2 " * 3000, "w2 w1 " * 3000)]
    df = spark.createDataFrame(rows + [(None, "w1", "w1"), (7, "w9 w9", "w1"), rows[3]], "id int, claim string, evidence string").withColumn("word", F.lit("x"))
    got = entailment.entailed(df, spark.createDataFrame([(t, 1) for t in corpus], "text string, word int")).collect()
    want = {i: _score(c, e, corpus) for i, c, e in rows}
    want[7] = max(want[7] or 0, _score("w9 w9", "w1", corpus))
    assert len(got) == len(want)
    for r in got:
        assert (r.score is None) == (want[r.id] is None) and (r.score is None or abs(r.score - want[r.id]) < 2e-6), r.id
        assert r.entailed == (r.score is not None and r.score >= entailment.LEAST)
    assert entailment.entailed(df.filter("id < 0"), df.select(F.col("claim").alias("text"))).count() == 0
