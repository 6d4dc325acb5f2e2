"""Mixes of training phases by exact token budgets.

Rows are taken in an order, while less than the budget's tokens went before.  The order is a text of one length, best
first (a class, then a hash, say), so its first characters make a histogram: the bin in which the budget is met is refined
until it is small, and only its rows are ranked.  No task orders more than that, and the driver sees bins alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters by which a bin is refined, and the rows from which on it is.
DIGITS = 3
RANKED = 100_000


@dataclass
class Border:
    """Rows whose order begins below prefix are taken; of those that begin with it, left tokens more."""

    prefix: str
    left: int


def border(rows: DataFrame, order: str, tokens: str, budget: int, ranked: int = RANKED) -> Border | None:
    """Where the budget is met; None if it is not.  Order texts begin with 4,096 different DIGITS at most, as hexadecimal ones do."""
    prefix, left, inside = "", budget, rows
    while True:
        begin = F.substring(order, 1, len(prefix) + DIGITS)
        bins = inside.groupBy(begin.alias("bin")).agg(F.sum(tokens).alias("t"), F.count("*").alias("n"), F.max(F.length(order)).alias("longest")).orderBy("bin").collect()
        met = None
        for b in bins:
            if left <= b.t:
                met = b
                break
            left -= b.t
        if met is None:
            return None
        if met.n <= ranked or len(met.bin) >= met.longest:
            return Border(met.bin, left)
        prefix = met.bin
        inside = rows.filter(F.col(order).startswith(prefix))


def take(rows: DataFrame, order: str, tokens: str, budget: int, ranked: int = RANKED) -> DataFrame:
    """Adds taken: whether less than budget tokens are in the rows before, by order; rows without tokens or order are not."""
    told = rows.withColumn("_order", F.when(F.col(tokens).isNotNull(), F.col(order)))
    if budget <= 0:
        return rows.withColumn("taken", F.lit(False))
    at = border(told.filter("_order IS NOT NULL"), "_order", tokens, budget, ranked)
    if at is None:
        return rows.withColumn("taken", F.col(order).isNotNull() & F.col(tokens).isNotNull())
    meets = F.coalesce(F.col("_order").startswith(at.prefix), F.lit(False))
    near = told.filter(meets)
    before = F.coalesce(F.sum(tokens).over(Window.orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked_rows = near.withColumn("taken", before < at.left)
    others = told.filter(~meets).withColumn("taken", F.coalesce(F.col("_order") < at.prefix, F.lit(False)))
    return ranked_rows.unionByName(others).drop("_order")


def drawn(seed: str, kind: str, key: str) -> Column:
    """A hash of a seed and a row's key, which is the last order of rows; distinct keys have distinct ones."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(kind), F.lit(":"), F.col(key).cast("string")), 256)


def three_phases(docs: DataFrame, tasks: DataFrame, main: int, anneal: int, anneal_tasks: int, sft: int) -> DataFrame:
    """(kind, id, n_tokens, phase) of docs (id, n_tokens, quality) and tasks (id, n_tokens), by token budgets.

    Anneal takes the best documents (quality 1, then 0, then unknown) and some tasks, main takes what documents are left, sft
    tasks alone; each draws by a hash of its own, and a row is in one phase at most: 'none' are the rest.
    """
    best = F.when(F.col("quality") == 1, "0").when(F.col("quality") == 0, "1").otherwise("2")
    d = docs.select(F.lit("doc").alias("kind"), "id", "n_tokens", best.alias("_best"))
    t = tasks.select(F.lit("task").alias("kind"), "id", "n_tokens")

    def phase(rows: DataFrame, name: str, first: Column, budget: int) -> tuple[DataFrame, DataFrame]:
        told = take(rows.withColumn("_drawn", F.concat(first, drawn(name, "kind", "id"))), "_drawn", "n_tokens", budget).drop("_drawn")
        return told.filter("taken").withColumn("phase", F.lit(name)), told.filter("NOT taken").drop("taken")

    annealed, d = phase(d, "anneal", F.col("_best"), anneal)
    mained, d = phase(d, "main", F.lit("0"), main)
    mixed, t = phase(t, "anneal", F.lit("0"), anneal_tasks)
    tuned, t = phase(t, "sft", F.lit("0"), sft)
    out = [x.select("kind", "id", "n_tokens", "phase") for x in (annealed, mained, mixed, tuned)]
    out += [x.select("kind", "id", "n_tokens", F.lit("none").alias("phase")) for x in (d, t)]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole
