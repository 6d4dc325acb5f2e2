"""Token budgets, items inside documents, and the hash of a frozen set, against plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import frozen, hygiene, mixture


@pytest.mark.parametrize("ranked", [1, 7, 10_000])
def test_budgets_are_exact_however_fine_the_bins(spark, ranked):
    rng = random.Random(ranked)
    rows = [(k, rng.randint(0, 9), hashlib.sha256(str(k % 190).encode()).hexdigest() if k < 190 else "0" + hashlib.sha256(str(k).encode()).hexdigest()[:63]) for k in range(200)]
    rows += [(500, None, "00"), (501, 3, None)]
    df = spark.createDataFrame(rows, "id int, n int, o string").cache()
    known = sorted((o, n, k) for k, n, o in rows if o is not None and n is not None)
    for budget in (-1, 0, 1, 50, 400, 10**6):
        before, want = 0, set()
        for _, n, k in known:
            if before < budget:
                want.add(k)
            before += n
        got = mixture.take(df, "o", "n", budget, ranked)
        assert {r.id for r in got.filter("taken").collect()} == want and got.count() == len(rows), budget
    assert mixture.take(df.filter("id < 0"), "o", "n", 5).count() == 0


def test_phases_share_no_row(spark):
    docs = spark.createDataFrame([(k, 10, [1, 0, None][k % 3]) for k in range(90)], "id long, n_tokens long, quality int")
    tasks = spark.createDataFrame([(k, 5) for k in range(20)], "id long, n_tokens long")
    got = mixture.three_phases(docs, tasks, 400, 350, 23, 1000).collect()
    assert len(got) == 110 == len({(r.kind, r.id) for r in got})
    tokens = {p: sum(r.n_tokens for r in got if (r.kind, r.phase) == p) for p in {(r.kind, r.phase) for r in got}}
    assert tokens == {("doc", "anneal"): 350, ("doc", "main"): 400, ("doc", "none"): 150, ("task", "anneal"): 25, ("task", "sft"): 75}
    best = [r.id % 3 for r in got if r.kind == "doc" and r.phase == "anneal"]
    assert best.count(0) == 30 and best.count(1) == 5 and best.count(2) == 0  # the next class only when the best is used up


def test_items_are_found_whatever_stands_around_them(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdefgh") for _ in range(6))
    stem = [word() for _ in range(12)]
    items = [(k, " ".join(stem + [word() for _ in range(rng.randint(12, 60))])) for k in range(30)] + [(90, "one two three"), (91, "One, two three!"), (92, None), (93, "The a an"), (None, "x y")]
    items.append((94, items[3][1].upper()))
    docs = [(1000 + k, " ".join([word() for _ in range(rng.randint(0, 80))]) + " " + items[k][1] + "? " + " ".join(word() for _ in range(20))) for k in range(30)]
    docs += [(1, " ".join(stem)), (2, "zero One two -- three four"), (3, None), (4, ""), (None, items[0][1]), (5, "one two"), (6, "q " * 5000), (7, items[5][1][: len(items[5][1]) // 3])]
    clash = lambda df: df.select("*", *[F.lit("x").alias(c) for c in ("_f", "f", "kind", "l", "n", "h", "_df")])
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    i = clash(spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in hygiene.contained(d, i).collect()}
    assert got == {(1000 + k, k) for k in range(30)} | {(1003, 94), (2, 90), (2, 91)}
    left = hygiene.without_items(d, i)
    assert {r.doc_id for r in left.collect()} == {1, 3, 4, 5, 6, 7, None} and left.columns == d.columns
    assert hygiene.contained(d.filter("doc_id < 0"), i).count() == 0 and hygiene.contained(d, i.filter("item_id < 0")).count() == 0


def plain_root(lines, leaf, fan):
    level = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    size = leaf
    while True:
        level = [hashlib.sha256("".join(level[k : k + size]).encode()).hexdigest() for k in range(0, len(level), size)]
        size = fan
        if len(level) <= 1:
            return level[0] if level else frozen.EMPTY


@pytest.mark.parametrize("n", [0, 1, 4, 5, 64, 65, 333])
def test_root_is_that_of_plain_hashing(spark, n):
    rows = [(7 * k - 50, f"line {k} é") for k in range(n)]
    df = spark.createDataFrame(rows, "pos long, line string")
    want = plain_root([x for _, x in rows], 4, 3)
    for parts in (1, 5):
        assert tuple(frozen.root(df.repartition(parts), 4, 3).first()) == (n, want)


def test_changed_leaves_are_named(spark):
    rows = [(k, f"line {k}") for k in range(40)]
    df = spark.createDataFrame(rows, "pos long, line string")
    other = spark.createDataFrame([(k, x + ("!" if k in (5, 33) else "")) for k, x in rows] + [(40, "more")], "pos long, line string")
    assert sorted(r.k for r in frozen.differing(df, other, 4).collect()) == [1, 8, 10]
