"""The gate: joins predictions to the evaluation set and reports on their grades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text

from .validator import graded


def last_predictions(preds: DataFrame) -> DataFrame:
    """(id, output): of several rows of an id the one of the largest line."""
    return preds.groupBy("id").agg(F.max_by("output", "line").alias("output"))


def join_predictions(examples: DataFrame, preds: DataFrame) -> DataFrame:
    """Every example with its output; an empty one where there is none.  Other predictions are ignored."""
    return examples.join(last_predictions(preds), "id", "left").withColumn("output", F.coalesce("output", F.lit("")))


#: Outputs that need no model, by name: an example's columns to its raw output.
BASELINES: dict[str, Callable[[], Column]] = {
    "abstain": lambda: F.lit('{"ok": false}'),
    "first_sentence": lambda: F.to_json(F.struct(F.lit(True).alias("ok"), text.first_sentence(F.col("document")).alias("ans"), text.first_sentence(F.col("document")).alias("ev"))),
}


def outputs(examples: DataFrame, preds: DataFrame | None = None, baseline: str | None = None) -> DataFrame:
    """Examples with outputs, either of predictions or of a named baseline."""
    if (preds is None) == (baseline is None):
        raise ValueError("give either predictions or a baseline")
    return join_predictions(examples, preds) if preds is not None else examples.withColumn("output", BASELINES[baseline]())


def metrics() -> dict[str, Column]:
    """Aggregates over graded rows; rates of no rows are null."""
    n, answered = F.count("*"), F.count_if("answered")
    rate = lambda c: F.try_divide(F.count_if(c).cast("double"), n)
    selective = lambda c: F.coalesce(F.try_divide(F.sum(F.when(F.col("answered") & F.col("gold_answerable"), F.col(c)).otherwise(0.0)), answered), F.lit(0.0))
    overall = lambda c: F.avg(F.when(F.col("gold_answerable"), F.col(c)).otherwise(F.col("answerable_correct").cast("double")))
    return {
        "n": n,
        "v0_pass_rate": rate("v0_pass"),
        "answerability_acc": rate("answerable_correct"),
        "coverage": rate("answered"),
        "selective_em": selective("em"),
        "selective_f1": selective("f1"),
        "overall_em": overall("em"),
        "overall_f1": overall("f1"),
    }


def report(grades: DataFrame, model: str, by: list[str] | None = None) -> DataFrame:
    """One row (or one for each value of by) with all metrics, rounded to six places."""
    columns = [(c if k == "n" else F.round(c, 6)).alias(k) for k, c in metrics().items()]
    rows = grades.groupBy(*(by or [])).agg(*columns)
    return rows.select(F.lit(model).alias("model"), *rows.columns)


def failures(grades: DataFrame) -> DataFrame:
    """(label, cnt) of the failures."""
    return grades.filter("v0_failure IS NOT NULL").groupBy(F.col("v0_failure").alias("label")).agg(F.count("*").alias("cnt"))


def report_json(grades: DataFrame, model: str) -> DataFrame:
    """The report with its histogram of failures as one pretty JSON text."""
    histogram = failures(grades).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "cnt")))).alias("v0_failures"))
    whole = report(grades, model).withColumn("v0_failures", histogram.scalar())
    return whole.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("report"))
