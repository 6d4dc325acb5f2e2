"""Selective answering: confidence curves, votes, resampling and held-out hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Hexadecimal digits of a drawn order that make a bin: 4,096 bins.
BIN_DIGITS = 3


def held_back(rows: DataFrame, best: Column, share: float, drawn: Column) -> DataFrame:
    """Adds phase: 'anneal' for the first floor(share * rows) of the best rows by their drawn hexadecimal order.

    Ranks are exact and no task orders more than a bin: rows are ranked in bins of their first digits, after those of
    earlier bins.
    """
    told = rows.withColumn("_best", F.coalesce(best, F.lit(False))).withColumn("_order", drawn).withColumn("_bin", F.substring("_order", 1, BIN_DIGITS))
    sizes = told.groupBy("_bin").agg(F.count_if("_best").alias("_own"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bin
    placed = sizes.select("_bin", F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy(F.lit(0))).alias("_all"))
    # Only the best are ranked; the others need no order.
    best_rows, others = told.filter("_best"), told.filter("NOT _best").select(*rows.columns, F.lit("main").alias("phase"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_bin").orderBy("_order"))
    ranked = best_rows.join(placed, "_bin").withColumn("_k", rank)
    return ranked.select(*rows.columns, F.when(F.col("_k") <= F.floor(F.col("_all") * F.lit(share)), "anneal").otherwise("main").alias("phase")).unionByName(others)


def risk_coverage(grades: DataFrame, confidence: str, points: tuple[float, ...], key: str = "id") -> DataFrame:
    """(point, n, em, f1): means over the surest ceil(point * n) rows, ties broken by key.

    Ranks are exact: rows are ranked in confidence bins, after the rows of surer bins.
    """
    bins = 4096
    b = F.least(F.lit(bins - 1), F.floor((1 - F.col(confidence)) * bins)).cast("int")
    rows = grades.withColumn("_b", b)
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sizes.select("_b", before.alias("_before"), F.sum("_n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc(confidence), key))
    ranked = rows.join(sized, "_b").withColumn("_k", F.col("_before") + own)
    told = ranked.withColumn("point", F.explode(F.array(*[F.lit(p) for p in points]))).filter(F.col("_k") <= F.ceil(F.col("point") * F.col("_all")))
    return told.groupBy("point").agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"))


#: Question words and the shape that an answer to them has.
QUESTION_TYPES = (("when", r"(?i)\bwhen\b|\bwhat year\b", r"[0-9]"), ("how_many", r"(?i)\bhow (?:many|much)\b", r"[0-9]"), ("who", r"(?i)\bwho\b", r"^\p{Lu}"))


def type_agreement(question: Column, answer: Column) -> Column:
    """Whether an answer has the shape that its question asks for; true for other questions."""
    out = F.lit(True)
    for _, asks, has in reversed(QUESTION_TYPES):
        out = F.when(question.rlike(asks), answer.rlike(has)).otherwise(out)
    return out


def majority(votes: DataFrame, key: str = "id", value: str = "ans") -> DataFrame:
    """(key, value, votes, share): the value most often given; of several the smallest."""
    counts = votes.groupBy(key, value).agg(F.count("*").alias("votes"))
    best = counts.groupBy(key).agg(F.sum("votes").alias("_all"), F.max("votes").alias("_m"))
    tied = counts.join(best.select(key, "_m", "_all"), key).filter("votes = _m")
    return tied.groupBy(key).agg(F.min(value).alias(value), F.max("votes").alias("votes"), F.max("_all").alias("_all")).select(key, value, "votes", F.round(F.col("votes") / F.col("_all"), 6).alias("share"))


def first_accepted(attempts: DataFrame, passed: Column, abstain: str) -> DataFrame:
    """(id, output, attempt): the first attempt that passes; an abstention where none does."""
    first = attempts.groupBy("id").agg(F.min_by("output", F.when(passed, F.col("attempt"))).alias("output"), F.min(F.when(passed, F.col("attempt"))).alias("attempt"))
    return first.select("id", F.when(F.col("attempt").isNull(), abstain).otherwise(F.col("output")).alias("output"), F.coalesce("attempt", F.lit(-1)).alias("attempt"))


def confusion(rows: DataFrame, truth: str, verdict: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(verdict).alias("verdict")).agg(F.count("*").alias("cnt"))


def never_train_on(docs: DataFrame, held: DataFrame, key: Column) -> DataFrame:
    """docs whose key no held-out row has; both sides have the columns of key."""
    marks = held.select(F.xxhash64(key).alias("_h"), F.sha2(key, 256).alias("_s")).distinct()
    return docs.withColumn("_h", F.xxhash64(key)).withColumn("_s", F.sha2(key, 256)).join(marks, ["_h", "_s"], "left_anti").drop("_h", "_s")
