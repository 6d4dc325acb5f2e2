"""Builds evaluation sets: flatten, sample a number of each class, sort, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def project(raw: DataFrame) -> DataFrame:
    """Raw question rows to examples: golds are distinct and sorted."""
    golds = F.array_sort(F.array_distinct(F.coalesce(F.col("answers.text"), F.array().cast("array<string>"))))
    return raw.select("id", "question", F.col("context").alias("document"), golds.alias("answers"))


def draw_order(seed: int) -> Column:
    """A rank of ids that any engine computes alike."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256)


def stratified(examples: DataFrame, each: int, seed: int = 0) -> DataFrame:
    """each rows of both classes (all if there are fewer), by the hash of seed and id."""
    order = Window.partitionBy(F.size("answers") > 0).orderBy(draw_order(seed), "id")
    return examples.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= each).drop("_k")


def json_line() -> Column:
    """An example as one line of JSON: keys sorted, blanks after separators, other than ASCII kept."""
    quoted = lambda c: F.expr(f"substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    golds = F.expr("array_join(transform(answers, a -> substr(to_json(array(a)), 2, length(to_json(array(a))) - 2)), ', ')")
    return F.concat(F.lit('{"answers": ['), golds, F.lit('], "document": '), quoted("document"), F.lit(', "id": '), quoted("id"), F.lit(', "question": '), quoted("question"), F.lit("}"))


def write_jsonl(examples: DataFrame, path: str) -> None:
    """Lines sorted by id, over as many files as there are partitions; their names sort as the ids do."""
    examples.select("id", json_line().alias("value")).orderBy("id").select("value").write.mode("overwrite").text(path)
