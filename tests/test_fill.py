"""The chunk fill in blocks against the fold over all rows."""

from __future__ import annotations

import random

import pytest

from tests.test_corpus import _fold
from tidewell.operators import corpus, fill, sampling


def _got(spark, rows, every, **how):
    df = spark.createDataFrame(rows, "pos long, n_tokens long, extra string").repartition(3)
    return {r.pos: r.chunk_id for r in fill.chunk_ids(df, every, **how).collect()}


@pytest.mark.parametrize(("every", "block", "fan"), [(1, 7, 2), (40, 7, 2), (300, 5, 3), (5_000, 9, 2), (100_000, 8, 4)])
def test_blocks_are_the_fold(spark, every, block, fan):
    rng = random.Random(every)
    sizes = [rng.choice([0, 0, 1, 5, 20, 90, 700]) for _ in range(160)]
    pos = sorted(rng.sample(range(-300, 900), len(sizes)))
    rows = [(p, n, "x") for p, n in zip(pos, sizes, strict=True)]
    rng.shuffle(rows)
    assert _got(spark, rows, every, block=block, fan=fan) == dict(zip(pos, _fold(sizes, every), strict=True))


def test_a_fill_that_goes_on(spark):
    rng = random.Random(5)
    sizes = [rng.randint(0, 30) for _ in range(90)]
    whole = _fold([60, *sizes], 100)
    rows = [(k, n, None) for k, n in enumerate(sizes)]
    assert list(dict(sorted(_got(spark, rows, 100, held=60, chunk=4, block=10, fan=2).items())).values()) == [c + 4 for c in whole[1:]]


def test_odd_rows(spark):
    assert _got(spark, [], 10) == {}
    assert _got(spark, [(3, None, "a"), (4, 12, None), (9, None, None), (None, 1, "b")], 10, block=1, fan=2) == {3: 0, 4: 0, 9: 1, None: 1}
    with pytest.raises(ValueError, match="flush_every"):
        fill.chunk_ids(spark.createDataFrame([], "pos long, n_tokens long"), 0)


def test_no_task_gets_all_rows(spark):
    """The largest group is a block or the steps of fan functions."""
    rows = [(k, 10, "") for k in range(4_000)]
    df = spark.createDataFrame(rows, "pos long, n_tokens long, extra string")
    plan = fill.chunk_ids(df, 100, block=50, fan=4)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "RoundRobin" not in plan
    assert _got(spark, rows, 100, block=50, fan=4) == {k: k // 10 for k in range(4_000)}


def test_best_so_far_in_blocks(spark):
    rng = random.Random(3)
    rows = [(step, rng.choice([None, 0.5, 1.0, 2.0, 3.0 - step / 100])) for step in rng.sample(range(1_000), 120)]
    df = spark.createDataFrame(rows, "step long, loss double").repartition(4)
    least, want = None, {}
    for step, loss in sorted(rows):
        want[step] = least
        least = loss if least is None or (loss is not None and loss < least) else least
    assert {r.step: r.b for r in corpus.min_before(df, "loss", "b", "step", block=9).collect()} == want
    assert {r.step: r.improved for r in sampling.running_best(df, "loss", "step").collect()} == {s: None if v is None else want[s] is None or v < want[s] for s, v in rows}
