"""Queries of the gate: text functions, output checks, grades, joins and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import gate, validator

from . import fixtures as fx
from .registry import query

MODEL = "fixture"


def _joined(spark, sf_dir) -> DataFrame:
    return gate.outputs(fx.examples(spark, sf_dir), preds=fx.predictions(spark, sf_dir))


def _grades(spark, sf_dir) -> DataFrame:
    return validator.graded(_joined(spark, sf_dir))


# --- text functions ---


def _text_query(name: str, f, sql) -> None:
    @query(name, f"SELECT doc_id, {sql} AS value FROM documents")
    def run(spark, sf_dir):
        return fx.table(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("value"))


_text_query("norm_lower", text.lower, fx.sql_lower("text"))
_text_query("norm_punct", text.strip_punctuation, fx.sql_punct("text"))
_text_query("norm_articles", lambda c: text.strip_articles(text.lower(c)), fx.sql_articles(fx.sql_lower("text")))
_text_query("norm_ws", text.collapse_white, fx.sql_white("text"))
_text_query("normalize_answer", text.normalize_answer, fx.sql_normal("text"))
_text_query("norm_tokens", lambda c: F.array_join(text.words(text.normalize_answer(c)), "|"), f"array_to_string({fx.sql_words(fx.sql_normal('text'))}, '|')")
_text_query("first_sentence", text.first_sentence, "split_part(text, '. ', 1)")
_text_query("doc_bytes", lambda c: F.octet_length(c).cast("long"), "CAST(strlen(text) AS BIGINT)")
_text_query(
    "byte_ids",
    lambda c: F.array_join(text.byte_ids(c).cast("array<string>"), " "),
    "array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(CAST('0x' || h AS INTEGER) AS VARCHAR)), ' ')",
)

_FIRST = "split_part(text, '. ', 1)"
_PAIRS = f"SELECT doc_id, {fx.sql_words('a')} AS p, {fx.sql_words('b')} AS g FROM (SELECT doc_id, {fx.sql_normal('text')} AS a, {fx.sql_normal(_FIRST)} AS b FROM documents)"


def _pairs(spark, sf_dir) -> DataFrame:
    """The words of each text and of its first sentence."""
    own = lambda c: text.words(text.normalize_answer(c))
    return fx.table(spark, sf_dir, "documents").select("doc_id", own(F.col("text")).alias("p"), own(text.first_sentence(F.col("text"))).alias("g"))


@query("token_overlap", f"SELECT doc_id, {fx.sql_overlap('p', 'g')} AS common FROM ({_PAIRS})")
def token_overlap(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", text.overlap(F.col("p"), F.col("g")).alias("common"))


@query("token_f1", f"SELECT doc_id, round({fx.sql_f1('p', 'g')}, 6) AS f1 FROM ({_PAIRS})")
def token_f1(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", F.round(text.token_f1(F.col("p"), F.col("g")), 6).alias("f1"))


# --- checks ---


def _checked(spark, sf_dir) -> DataFrame:
    return validator.checked(_joined(spark, sf_dir))


@query("v0_check", fx.gate_sql("SELECT id, coalesce(v0_failure, 'pass') AS verdict FROM checked"))
def v0_check(spark, sf_dir):
    return _checked(spark, sf_dir).select("id", F.coalesce("v0_failure", F.lit("pass")).alias("verdict"))


def _failure_query(label: str) -> None:
    @query(f"v0_{label}", fx.gate_sql(f"SELECT id, output FROM checked WHERE v0_failure = '{label}'"))
    def run(spark, sf_dir):
        return _checked(spark, sf_dir).filter(F.col("v0_failure") == label).select("id", "output")


for _label in validator.FAILURES:
    _failure_query(_label)


# --- joins and grades ---


@query("preds_last_wins", f"WITH {fx.EXAMPLES}, {fx.PREDICTIONS} SELECT id, arg_max(output, line) AS output FROM preds GROUP BY id")
def preds_last_wins(spark, sf_dir):
    return gate.last_predictions(fx.predictions(spark, sf_dir))


@query("gate_join", f"WITH {fx.EXAMPLES}, {fx.PREDICTIONS} SELECT id, output, CAST(len(answers) AS INTEGER) AS n_answers FROM joined")
def gate_join(spark, sf_dir):
    return _joined(spark, sf_dir).select("id", "output", F.size("answers").alias("n_answers"))


@query("gate_rows", fx.gate_sql("SELECT id, v0_pass, coalesce(v0_failure, '') AS v0_failure, answered, answerable_correct, em, round(f1, 6) AS f1, gold_answerable FROM grades"))
def gate_rows(spark, sf_dir):
    g = _grades(spark, sf_dir)
    return g.select("id", "v0_pass", F.coalesce("v0_failure", F.lit("")).alias("v0_failure"), "answered", "answerable_correct", "em", F.round("f1", 6).alias("f1"), "gold_answerable")


@query("v1_grade", fx.gate_sql("SELECT id, answerable_correct, em, round(f1, 6) AS f1 FROM grades WHERE v0_pass"))
def v1_grade(spark, sf_dir):
    return _grades(spark, sf_dir).filter("v0_pass").select("id", "answerable_correct", "em", F.round("f1", 6).alias("f1"))


@query("span_em", fx.gate_sql("SELECT id, em FROM grades WHERE answered AND gold_answerable"))
def span_em(spark, sf_dir):
    return _grades(spark, sf_dir).filter("answered AND gold_answerable").select("id", "em")


@query("span_f1", fx.gate_sql("SELECT id, round(f1, 6) AS f1 FROM grades WHERE answered AND gold_answerable"))
def span_f1(spark, sf_dir):
    return _grades(spark, sf_dir).filter("answered AND gold_answerable").select("id", F.round("f1", 6).alias("f1"))


# --- reports ---


@query("gate_report", fx.report_sql(MODEL))
def gate_report(spark, sf_dir):
    return gate.report(_grades(spark, sf_dir), MODEL)


def _metric_query(name: str) -> None:
    @query(name, fx.gate_sql(f"SELECT round({fx.METRICS[name]}, 6) AS {name} FROM grades"))
    def run(spark, sf_dir):
        return _grades(spark, sf_dir).agg(F.round(gate.metrics()[name], 6).alias(name))


for _name in fx.METRICS:
    _metric_query(_name)


@query("v0_failures", fx.gate_sql("SELECT v0_failure AS label, count(*) AS cnt FROM grades WHERE v0_failure IS NOT NULL GROUP BY 1"))
def v0_failures(spark, sf_dir):
    return gate.failures(_grades(spark, sf_dir))


def _baseline_query(name: str) -> None:
    @query(f"baseline_{name}_report", fx.report_sql(f"baseline:{name}", name))
    def run(spark, sf_dir):
        return gate.report(validator.graded(gate.outputs(fx.examples(spark, sf_dir), baseline=name)), f"baseline:{name}")


for _name in gate.BASELINES:
    _baseline_query(_name)


_BY_SHAPE = ", ".join(f"round({v}, 6) AS {k}" for k, v in fx.METRICS.items())


@query("leaderboard", fx.gate_sql(f"SELECT 'all' AS model, family, count(*) AS n, {_BY_SHAPE} FROM (SELECT *, CAST(id AS BIGINT) % 4 AS family FROM grades) GROUP BY family"))
def leaderboard(spark, sf_dir):
    """The report of several sets of predictions at once."""
    return gate.report(_grades(spark, sf_dir).withColumn("family", F.col("id").cast("long") % 4), "all", ["family"])
