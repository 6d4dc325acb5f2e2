"""Output checks and grades.

``checked`` adds the failure label of a raw output, ``graded`` the whole grade.  Both keep all rows and stay
in the JVM; the costly parts are evaluated only where the cheap tests pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import strict_json, text

#: Failure labels in the order of the tests.
FAILURES = ("not_json", "bad_schema", "empty_field", "ev_not_in_doc", "ans_not_in_ev")


def parsed(df: DataFrame, output: str = "output") -> DataFrame:
    """Adds _json, _keys, _ok, _ans, _ev: what the tests need of an output, once."""
    strict_json.take_last_key(df.sparkSession)
    raw = strict_json.plain(F.coalesce(F.col(output), F.lit("")))
    df = df.withColumn("_raw", raw).withColumn("_json", strict_json.is_json(F.col("_raw")))
    held = F.when(F.col("_json"), F.col("_raw"))
    df = df.withColumn("_keys", strict_json.keys(held))
    is_flag = strict_json.field_type(held, "ok") == "BOOLEAN"
    strings = (strict_json.field_type(held, "ans") == "STRING") & (strict_json.field_type(held, "ev") == "STRING")
    return df.select(
        "*",
        F.when(is_flag & F.col("_keys").isNotNull(), strict_json.field_text(held, "ok") == "true").alias("_ok"),
        F.when(strings, strict_json.field_text(held, "ans")).alias("_ans"),
        F.when(strings, strict_json.field_text(held, "ev")).alias("_ev"),
    )


def failure(document: Column) -> Column:
    """The first failing test of a parsed row; null if it passes."""
    names = lambda *k: F.array(*[F.lit(x) for x in k])
    ok, keys, ans, ev = (F.col(c) for c in ("_ok", "_keys", "_ans", "_ev"))
    return (
        F.when(~F.col("_json"), "not_json")
        .when(ok.isNull(), "bad_schema")
        .when(~ok & (keys == names("ok")), None)
        .when(~ok | (keys != names("ans", "ev", "ok")) | ans.isNull(), "bad_schema")
        .when(text.blank(ans) | text.blank(ev), "empty_field")
        .when(~F.contains(document, ev), "ev_not_in_doc")
        .when(~F.contains(ev, ans), "ans_not_in_ev")
    )


def checked(df: DataFrame, output: str = "output", document: str = "document") -> DataFrame:
    """Adds v0_failure, and _ok and _ans of the outputs, to df."""
    out = parsed(df, output).withColumn("v0_failure", failure(F.col(document)))
    return out.drop("_raw", "_json", "_keys", "_ev")


def graded(df: DataFrame, output: str = "output", document: str = "document", answers: str = "answers") -> DataFrame:
    """df with v0_pass, v0_failure, answered, answerable_correct, em, f1, gold_answerable."""
    out = checked(df, output, document)
    passed, gold = F.col("v0_failure").isNull(), F.size(answers) > 0
    answered = passed & F.coalesce(F.col("_ok"), F.lit(False))
    both = answered & gold
    # Normal forms are columns of their own, so that no lambda computes them again for each gold answer.
    out = out.withColumn("_own", F.when(both, text.normalize_answer(F.col("_ans"))))
    out = out.withColumn("_words", text.words(F.col("_own"))).withColumn("_golds", F.when(both, F.transform(answers, text.normalize_answer)))
    em = F.array_max(F.transform("_golds", lambda g: (g == F.col("_own")).cast("double")))
    f1 = F.array_max(F.transform("_golds", lambda g: text.token_f1(F.col("_words"), text.words(g))))
    return out.select(
        *df.columns,
        passed.alias("v0_pass"),
        "v0_failure",
        answered.alias("answered"),
        (passed & (answered == gold)).alias("answerable_correct"),
        F.when(both, em).otherwise(0.0).alias("em"),
        F.when(both, f1).otherwise(0.0).alias("f1"),
        gold.alias("gold_answerable"),
    )
