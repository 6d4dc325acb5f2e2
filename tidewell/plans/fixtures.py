"""Evaluation rows and predictions derived from documents, alike in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")


def raw_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question, context, answers.text) with repeated and unsorted golds."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring_index("text", ". ", 1).alias("fs"))
    golds = F.array(F.substring("fs", 1, 20), F.lower(F.substring("fs", 1, 20)), F.substring("fs", 1, 10), F.substring("fs", 1, 20))
    has = F.floor(F.col("doc_id") / 10) % 2 == 0
    answers = F.struct(F.when(has, golds).otherwise(F.array().cast("array<string>")).alias("text"))
    return d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), F.col("text").alias("context"), answers.alias("answers"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.operators.evalset import project

    return project(raw_questions(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, output, line): one output shape for each last digit of the id, and stale earlier lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", ". ", 1).alias("fs"))
    q = lambda x: f"substr(to_json(array({x})), 2, length(to_json(array({x}))) - 2)"
    answer = lambda a, e: f"""concat('{{"ok": true, "ans": ', {q(a)}, ', "ev": ', {q(e)}, '}}')"""
    shape = f"""CASE doc_id % 10
        WHEN 0 THEN {answer("substr(fs, 1, 20)", "fs")}
        WHEN 1 THEN '{{"ok": false}}'
        WHEN 2 THEN concat('The answer is ', substr(fs, 1, 20))
        WHEN 3 THEN '{{"ok": false, "ans": "x"}}'
        WHEN 4 THEN {answer("' '", "fs")}
        WHEN 5 THEN {answer("substr(fs, 1, 20)", "concat(fs, '@@')")}
        WHEN 6 THEN {answer("concat(fs, '@@')", "fs")}
        WHEN 7 THEN {answer("substr(fs, 1, 20)", "fs")}
        WHEN 8 THEN {answer("substr(fs, 1, 40)", "fs")} END"""
    rows = d.filter("doc_id % 10 != 9").select(F.col("doc_id").cast("string").alias("id"), F.expr(shape).alias("output"), (2 * F.col("doc_id") + 1).alias("line"))
    stale = d.filter("doc_id % 10 = 1").select(F.col("doc_id").cast("string").alias("id"), F.lit("stale").alias("output"), (2 * F.col("doc_id")).alias("line"))
    return rows.unionByName(stale)


WHITE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def sql_lower(x: str) -> str:
    return f"lower({x})"


def sql_punct(x: str) -> str:
    return rf"regexp_replace({x}, '[!-/:-@\[-`{{-~]', '', 'g')"


def sql_articles(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]'), lambda w: CASE WHEN w IN ('a', 'an', 'the') THEN ' ' ELSE w END), '')"


def sql_white(x: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array({x}, '{WHITE}+'), lambda z: z <> ''), ' ')"


def sql_normal(x: str) -> str:
    return sql_white(sql_articles(sql_punct(sql_lower(x))))


def sql_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda z: z <> '')"


def sql_overlap(p: str, g: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(list_intersect({p}, {g}), lambda w: least(len(list_filter({p}, lambda u: u = w)), len(list_filter({g}, lambda u: u = w))))), 0) AS INTEGER)"


def sql_f1(p: str, g: str) -> str:
    return f"CASE WHEN len({p}) + len({g}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {sql_overlap(p, g)} / (len({p}) + len({g})) END"


_ANSWER = lambda a, e: f"""'{{"ok": true, "ans": ' || CAST(to_json({a}) AS VARCHAR) || ', "ev": ' || CAST(to_json({e}) AS VARCHAR) || '}}'"""

EXAMPLES = """fs AS (SELECT doc_id, text, split_part(text, '. ', 1) AS fs FROM documents),
examples AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'q' || doc_id AS question, text AS document,
  CASE WHEN (doc_id // 10) % 2 = 0 THEN list_sort(list_distinct([substr(fs, 1, 20), lower(substr(fs, 1, 20)), substr(fs, 1, 10)])) ELSE CAST([] AS VARCHAR[]) END AS answers FROM fs)"""

PREDICTIONS = f"""preds AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 10
  WHEN 0 THEN {_ANSWER("substr(fs, 1, 20)", "fs")}
  WHEN 1 THEN '{{"ok": false}}'
  WHEN 2 THEN 'The answer is ' || substr(fs, 1, 20)
  WHEN 3 THEN '{{"ok": false, "ans": "x"}}'
  WHEN 4 THEN {_ANSWER("' '", "fs")}
  WHEN 5 THEN {_ANSWER("substr(fs, 1, 20)", "fs || '@@'")}
  WHEN 6 THEN {_ANSWER("fs || '@@'", "fs")}
  WHEN 7 THEN {_ANSWER("substr(fs, 1, 20)", "fs")}
  WHEN 8 THEN {_ANSWER("substr(fs, 1, 40)", "fs")} END AS output, 2 * doc_id + 1 AS line FROM fs WHERE doc_id % 10 <> 9
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'stale', 2 * doc_id FROM fs WHERE doc_id % 10 = 1),
joined AS (SELECT e.*, coalesce(p.output, '') AS output FROM examples e LEFT JOIN
  (SELECT id, arg_max(output, line) AS output FROM preds GROUP BY id) p USING (id))"""

BASELINE = {
    "abstain": """joined AS (SELECT *, '{"ok": false}' AS output FROM examples)""",
    "first_sentence": """joined AS (SELECT *, '{"ok":true,"ans":' || CAST(to_json(split_part(document, '. ', 1)) AS VARCHAR) || ',"ev":' || CAST(to_json(split_part(document, '. ', 1)) AS VARCHAR) || '}' AS output FROM examples)""",
}

GRADES = f"""j AS (SELECT *, CASE WHEN json_valid(output) THEN output ELSE 'null' END AS o, json_valid(output) AS valid FROM joined),
parsed AS (SELECT *, CASE WHEN json_type(o) = 'OBJECT' THEN list_sort(list_distinct(json_keys(o))) END AS ks,
  CASE WHEN json_type(o, '$.ok') = 'BOOLEAN' THEN json_extract_string(o, '$.ok') = 'true' END AS ok,
  CASE WHEN json_type(o, '$.ans') = 'VARCHAR' AND json_type(o, '$.ev') = 'VARCHAR' THEN json_extract_string(o, '$.ans') END AS ans,
  CASE WHEN json_type(o, '$.ans') = 'VARCHAR' AND json_type(o, '$.ev') = 'VARCHAR' THEN json_extract_string(o, '$.ev') END AS ev FROM j),
checked AS (SELECT *, CASE WHEN NOT valid THEN 'not_json' WHEN ok IS NULL OR ks IS NULL THEN 'bad_schema'
  WHEN NOT ok AND ks = ['ok'] THEN NULL WHEN NOT ok OR ks <> ['ans', 'ev', 'ok'] OR ans IS NULL THEN 'bad_schema'
  WHEN regexp_full_match(ans, '{WHITE}*') OR regexp_full_match(ev, '{WHITE}*') THEN 'empty_field'
  WHEN NOT contains(document, ev) THEN 'ev_not_in_doc' WHEN NOT contains(ev, ans) THEN 'ans_not_in_ev' END AS v0_failure FROM parsed),
flags AS (SELECT *, v0_failure IS NULL AS v0_pass, v0_failure IS NULL AND coalesce(ok, false) AS answered, len(answers) > 0 AS gold_answerable FROM checked),
scored AS (SELECT *, CASE WHEN answered AND gold_answerable THEN {sql_normal("ans")} END AS own FROM flags),
golds AS (SELECT id, max(CASE WHEN own = g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS em, max({sql_f1("pw", "gw")}) AS f1 FROM (
  SELECT id, own, g, {sql_words("own")} AS pw, {sql_words("g")} AS gw FROM (SELECT id, own, {sql_normal("a")} AS g FROM
  (SELECT id, own, unnest(answers) AS a FROM scored WHERE own IS NOT NULL))) GROUP BY id),
grades AS (SELECT s.id, v0_pass, v0_failure, answered, v0_pass AND answered = gold_answerable AS answerable_correct,
  coalesce(g.em, 0.0::DOUBLE) AS em, coalesce(g.f1, 0.0::DOUBLE) AS f1, gold_answerable FROM scored s LEFT JOIN golds g USING (id))"""

METRICS = {
    "v0_pass_rate": "count(*) FILTER (WHERE v0_pass)::DOUBLE / count(*)",
    "answerability_acc": "count(*) FILTER (WHERE answerable_correct)::DOUBLE / count(*)",
    "coverage": "count(*) FILTER (WHERE answered)::DOUBLE / count(*)",
    "selective_em": "coalesce(sum(CASE WHEN answered AND gold_answerable THEN em ELSE 0 END) / nullif(count(*) FILTER (WHERE answered), 0), 0)",
    "selective_f1": "coalesce(sum(CASE WHEN answered AND gold_answerable THEN f1 ELSE 0 END) / nullif(count(*) FILTER (WHERE answered), 0), 0)",
    "overall_em": "avg(CASE WHEN gold_answerable THEN em ELSE answerable_correct::DOUBLE END)",
    "overall_f1": "avg(CASE WHEN gold_answerable THEN f1 ELSE answerable_correct::DOUBLE END)",
}


def gate_sql(select: str, baseline: str | None = None) -> str:
    """SQL over grades, with outputs of the predictions or of a baseline."""
    return f"WITH {EXAMPLES}, {BASELINE[baseline] if baseline else PREDICTIONS}, {GRADES} {select}"


def report_sql(model: str, baseline: str | None = None) -> str:
    return gate_sql(f"SELECT '{model}' AS model, count(*) AS n, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in METRICS.items()) + " FROM grades", baseline)
