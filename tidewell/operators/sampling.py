"""Next-token sampling and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.operators import corpus


def temperature(logits: DataFrame, t: float) -> DataFrame:
    return logits.withColumn("logit", F.col("logit") / F.lit(float(t)))


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """Rows (seq, token, logit) among the k largest of their sequence, ties at the last place kept."""
    place = F.rank().over(Window.partitionBy("seq").orderBy(F.desc("logit")))
    return logits.withColumn("_r", place).filter(F.col("_r") <= k).drop("_r")


def softmax(logits: DataFrame) -> DataFrame:
    """Adds p."""
    w = Window.partitionBy("seq")
    e = F.exp(F.col("logit") - F.max("logit").over(w))
    return logits.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def uniform(seed: str, key: Column) -> Column:
    """A number from 0 to 1 by a hash, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample(probabilities: DataFrame, seed: str) -> DataFrame:
    """(seq, token): the first token at which the running sum of p passes a uniform number."""
    w = Window.partitionBy("seq").orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    run = probabilities.withColumn("_c", F.sum("p").over(w)).withColumn("_u", uniform(seed, F.col("seq")))
    last = F.max("token")
    return run.groupBy("seq").agg(F.coalesce(F.min(F.when(F.col("_c") >= F.col("_u"), F.col("token"))), last).alias("token"))


def crop(ids: Column, length: int) -> Column:
    """The last length ids."""
    return F.when(F.size(ids) > length, F.slice(ids, -length, length)).otherwise(ids)


def cosine_rate(it: Column, warmup: int, most: int, rate: float, least: float) -> Column:
    """Linear to rate over warmup steps, then half a cosine down to least at step most."""
    part = (it - warmup) / F.lit(float(max(1, most - warmup)))
    return F.when(it < warmup, rate * (it + 1) / F.lit(float(warmup))).when(it > most, F.lit(least)).otherwise(least + 0.5 * (1 + F.cos(F.lit(math.pi) * part)) * (rate - least))


def plateau_rate(it: Column, warmup: int, decay_from: int, most: int, rate: float, least: float) -> Column:
    """Linear warm-up, a plateau, and a linear decay from step decay_from."""
    down = rate + (least - rate) * (it - decay_from) / F.lit(float(max(1, most - decay_from)))
    return F.when(it < warmup, rate * (it + 1) / F.lit(float(warmup))).when(it < decay_from, F.lit(rate)).when(it <= most, down).otherwise(F.lit(least))


def running_best(metrics: DataFrame, value: str, order: str, partition: list[str] | None = None) -> DataFrame:
    """Adds improved: whether value is below all earlier ones in order, a number.

    Without partition the least value before a row comes from blocks of the order, so no task sees all rows.
    """
    if partition:
        w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        before = metrics.withColumn("_least", F.min(value).over(w))
    else:
        before = corpus.min_before(metrics, value, "_least", order)
    return before.withColumn("improved", F.col(value) < F.coalesce(F.col("_least"), F.lit(float("inf")))).drop("_least")


def generate(context: list[int], logits_of, n: int, block: int, t: float = 1.0, k: int | None = None, seed: str = "0") -> list[int]:
    """Appends n tokens one by one: crop, logits, temperature, top-k, softmax, draw.  It does not stop early.

    logits_of maps a list of ids to a DataFrame (seq, token, logit) of one sequence.
    """
    out = list(context)
    for step in range(n):
        rows = temperature(logits_of(out[-block:]), t)
        rows = top_k(rows, k) if k else rows
        out.append(sample(softmax(rows), f"{seed}:{step}").first().token)
    return out
