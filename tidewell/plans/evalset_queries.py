"""Queries of the evaluation-set builder and of plain sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import evalset, frozen
from tidewell.sources import jsonl

from . import fixtures as fx
from .registry import query

EACH = 100
SEED = 0
_DRAWN = f"""drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY len(answers) > 0 ORDER BY sha256('{SEED}:' || id), id) AS k FROM examples) WHERE k <= {EACH})"""
_Q = "CAST(to_json({}) AS VARCHAR)"
_LINE = f"""'{{"answers": [' || array_to_string(list_transform(answers, lambda a: {_Q.format("a")}), ', ') || '], "document": ' || {_Q.format("document")} || ', "id": ' || {_Q.format("id")} || ', "question": ' || {_Q.format("question")} || '}}'"""
_GOLDS = "array_to_string(answers, '|')"


def _drawn(spark, sf_dir):
    return evalset.stratified(fx.examples(spark, sf_dir), EACH, SEED)


@query("scan_corpus", "SELECT doc_id AS pos, text FROM documents")
def scan_corpus(spark, sf_dir):
    return fx.docs(spark, sf_dir)


@query("eval_project", f"WITH {fx.EXAMPLES} SELECT id, question, document, {_GOLDS} AS answers FROM examples")
def eval_project(spark, sf_dir):
    return fx.examples(spark, sf_dir).select("id", "question", "document", F.array_join("answers", "|").alias("answers"))


@query("gold_dedupe", f"WITH {fx.EXAMPLES} SELECT id, {_GOLDS} AS golds, CAST(len(answers) AS INTEGER) AS n FROM examples WHERE len(answers) > 0")
def gold_dedupe(spark, sf_dir):
    return fx.examples(spark, sf_dir).filter(F.size("answers") > 0).select("id", F.array_join("answers", "|").alias("golds"), F.size("answers").alias("n"))


@query("answerable_split", f"WITH {fx.EXAMPLES} SELECT id, CASE WHEN len(answers) > 0 THEN 'answerable' ELSE 'unanswerable' END AS class FROM examples")
def answerable_split(spark, sf_dir):
    return fx.examples(spark, sf_dir).select("id", F.when(F.size("answers") > 0, "answerable").otherwise("unanswerable").alias("class"))


@query("eval_class_counts", f"WITH {fx.EXAMPLES} SELECT len(answers) > 0 AS answerable, least(count(*), {EACH}) AS cnt FROM examples GROUP BY 1")
def eval_class_counts(spark, sf_dir):
    return fx.examples(spark, sf_dir).groupBy((F.size("answers") > 0).alias("answerable")).agg(F.least(F.count("*"), F.lit(EACH).cast("long")).alias("cnt"))


@query("stratified_sample", f"WITH {fx.EXAMPLES}, {_DRAWN} SELECT id, len(answers) > 0 AS answerable FROM drawn")
def stratified_sample(spark, sf_dir):
    return _drawn(spark, sf_dir).select("id", (F.size("answers") > 0).alias("answerable"))


@query("eval_union", f"WITH {fx.EXAMPLES}, {_DRAWN} SELECT id, question FROM drawn WHERE len(answers) > 0 UNION ALL SELECT id, question FROM drawn WHERE len(answers) = 0")
def eval_union(spark, sf_dir):
    d = _drawn(spark, sf_dir).select("id", "question", (F.size("answers") > 0).alias("a"))
    return d.filter("a").unionByName(d.filter("NOT a")).select("id", "question")


@query("eval_sorted", f"WITH {fx.EXAMPLES}, {_DRAWN} SELECT row_number() OVER (ORDER BY id) AS place, id FROM drawn ORDER BY id")
def eval_sorted(spark, sf_dir):
    """The place of each drawn example in the file; the sample is bounded, so one task may order it."""
    from pyspark.sql.window import Window

    return _drawn(spark, sf_dir).select(F.row_number().over(Window.orderBy("id")).cast("long").alias("place"), "id").orderBy("id")


@query("eval_jsonl_lines", f"WITH {fx.EXAMPLES}, {_DRAWN} SELECT id, {_LINE} AS line FROM drawn")
def eval_jsonl_lines(spark, sf_dir):
    return _drawn(spark, sf_dir).select("id", evalset.json_line().alias("line"))


@query("eval_row_hash", f"WITH {fx.EXAMPLES}, {_DRAWN} SELECT id, sha256({_LINE}) AS sha256 FROM drawn")
def eval_row_hash(spark, sf_dir):
    return _drawn(spark, sf_dir).select("id", F.sha2(evalset.json_line(), 256).alias("sha256"))


@query("jsonl_roundtrip", f"WITH {fx.EXAMPLES} SELECT id, question, document, {_GOLDS} AS answers FROM examples")
def jsonl_roundtrip(spark, sf_dir):
    """Every example written as a line of JSON and parsed again under the declared schema."""
    lines = fx.examples(spark, sf_dir).select(evalset.json_line().alias("value"))
    return jsonl.parse(lines, jsonl.EXAMPLE).select("id", "question", "document", F.array_join("answers", "|").alias("answers"))


#: Levels that the SQL writes out above the leaves: FAN to that power leaves at most.
_LEVELS = 4
_TREE = ", ".join(
    f"l{k + 1} AS (SELECT k // {frozen.FAN} AS k, CASE WHEN (SELECT count(*) FROM l{k}) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS h FROM l{k} GROUP BY 1)" for k in range(_LEVELS)
)


@query("eval_frozen_root", f"""WITH {fx.EXAMPLES}, lines AS (SELECT row_number() OVER (ORDER BY CAST(id AS BIGINT)) - 1 AS k, sha256({_LINE}) AS h FROM examples),
  l0 AS (SELECT k // {frozen.LEAF} AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM (SELECT k, h FROM lines) GROUP BY 1), {_TREE} SELECT (SELECT count(*) FROM lines) AS n, h AS root FROM l{_LEVELS}""")  # fmt: skip
def eval_frozen_root(spark, sf_dir):
    """The one hash that pins all examples, whatever files they are in."""
    lines = fx.examples(spark, sf_dir).select(F.col("id").cast("long").alias("pos"), evalset.json_line().alias("line"))
    return frozen.root(lines)
