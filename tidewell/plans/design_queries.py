"""Queries of capabilities that build on the gate: curves, votes, acceptance, hygiene, mixes and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import entailment, gate, hygiene, mixture, selection, validator

from . import fixtures as fx
from .registry import query

_CONF = "CAST('0x' || substr(md5('conf:' || id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def _grades(spark, sf_dir):
    return validator.graded(gate.outputs(fx.examples(spark, sf_dir), preds=fx.predictions(spark, sf_dir)))


@query("risk_coverage", fx.gate_sql(f"""SELECT point, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1 FROM
  (SELECT em, f1, row_number() OVER (ORDER BY {_CONF} DESC, id) AS k, count(*) OVER () AS n FROM grades), (SELECT unnest([0.5, 0.8, 1.0]::DOUBLE[]) AS point) WHERE k <= ceil(point * n) GROUP BY point"""))  # fmt: skip
def risk_coverage(spark, sf_dir):
    from tidewell.operators.sampling import uniform

    return selection.risk_coverage(_grades(spark, sf_dir).withColumn("conf", uniform("conf", F.col("id"))), "conf", (0.5, 0.8, 1.0))


_ASK = "CASE doc_id % 3 WHEN 0 THEN 'When did it happen?' WHEN 1 THEN 'How many were there?' ELSE 'Who was it?' END"


@query("question_type_agreement", f"""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN regexp_matches(a, '^\\p{{Lu}}') ELSE regexp_matches(a, '[0-9]') END AS agrees FROM (SELECT doc_id, split_part(text, '. ', 1) AS a FROM documents)""")
def question_type_agreement(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", selection.type_agreement(F.expr(_ASK), text.first_sentence(F.col("text"))).alias("agrees"))


@query("self_consistency", """WITH w AS (SELECT user_id AS id, event_type AS ans, count(*) AS votes FROM events GROUP BY 1, 2), m AS (SELECT id, max(votes) AS m, sum(votes) AS s FROM w GROUP BY 1)
  SELECT w.id, min(ans) AS ans, max(votes) AS votes, round(max(votes) / max(s)::DOUBLE, 6) AS share FROM w JOIN m ON w.id = m.id AND votes = m GROUP BY 1""")  # fmt: skip
def self_consistency(spark, sf_dir):
    """Each user's most frequent event: votes of several samples of one question."""
    return selection.majority(fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("ans")))


@query("accept_or_abstain", fx.gate_sql("""SELECT id, CASE WHEN attempt IS NULL THEN '{"ok": false}' ELSE output END AS output, CAST(coalesce(attempt, -1) AS INTEGER) AS attempt FROM
  (SELECT e.id, arg_min(a.output, a.attempt) FILTER (WHERE a.good) AS output, min(a.attempt) FILTER (WHERE a.good) AS attempt FROM examples e JOIN
   (SELECT id, output, 0 AS attempt, v0_pass AS good FROM flags UNION ALL SELECT id, '{"ok": true, "ans": "", "ev": ""}', 1, false FROM flags
    UNION ALL SELECT id, CAST(NULL AS VARCHAR), 2, false FROM flags WHERE false) a USING (id) GROUP BY e.id)"""))  # fmt: skip
def accept_or_abstain(spark, sf_dir):
    """The first output of each example that passes the checks; the second attempt is always blank."""
    first = gate.outputs(fx.examples(spark, sf_dir), preds=fx.predictions(spark, sf_dir)).withColumn("attempt", F.lit(0))
    second = first.withColumn("output", F.lit('{"ok": true, "ans": "", "ev": ""}')).withColumn("attempt", F.lit(1))
    checked = validator.checked(first.unionByName(second))
    return selection.first_accepted(checked, F.col("v0_failure").isNull(), '{"ok": false}')


@query("validator_confusion", fx.gate_sql("SELECT l.quality AS truth, g.v0_pass AS verdict, count(*) AS cnt FROM grades g JOIN labels l ON l.doc_id = CAST(g.id AS BIGINT) GROUP BY 1, 2"))
def validator_confusion(spark, sf_dir):
    rows = _grades(spark, sf_dir).withColumn("doc_id", F.col("id").cast("long")).join(fx.table(spark, sf_dir, "labels"), "doc_id")
    return selection.confusion(rows, "quality", "v0_pass")


@query("prompt_order", f"WITH {fx.EXAMPLES} SELECT id, sha256(concat_ws(chr(10), question, document, question, 'Answer:')) AS prompt_sha256 FROM examples")
def prompt_order(spark, sf_dir):
    return fx.examples(spark, sf_dir).select("id", F.sha2(F.concat_ws("\n", "question", "document", "question", F.lit("Answer:")), 256).alias("prompt_sha256"))


@query("synthetic_filter", fx.gate_sql("SELECT id, output FROM flags WHERE v0_pass AND answered"))
def synthetic_filter(spark, sf_dir):
    rows = validator.checked(gate.outputs(fx.examples(spark, sf_dir), preds=fx.predictions(spark, sf_dir)))
    return rows.filter("v0_failure IS NULL AND _ok").select("id", "output")


@query("eval_hygiene", f"""SELECT doc_id FROM documents WHERE {fx.sql_normal('text')} NOT IN (SELECT {fx.sql_normal('text')} FROM benchmark)""")
def eval_hygiene(spark, sf_dir):
    held = fx.table(spark, sf_dir, "benchmark").select("text")
    return selection.never_train_on(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), held, text.normalize_answer(F.col("text"))).select("doc_id")


@query("phase_mix", """WITH r AS (SELECT d.doc_id, l.quality, row_number() OVER (PARTITION BY l.quality ORDER BY sha256('mix:' || d.doc_id)) AS k, count(*) OVER () AS n FROM documents d JOIN labels l USING (doc_id))
  SELECT doc_id, CASE WHEN quality = 1 AND k <= floor(n * 0.15) THEN 'anneal' ELSE 'main' END AS phase FROM r""")  # fmt: skip
def phase_mix(spark, sf_dir):
    """A share of 15 per cent, of the best quality, is held back for the second phase."""
    rows = fx.table(spark, sf_dir, "documents").select("doc_id").join(fx.table(spark, sf_dir, "labels"), "doc_id")
    return selection.held_back(rows, F.col("quality") == 1, 0.15, F.sha2(F.concat(F.lit("mix:"), F.col("doc_id").cast("string")), 256)).select("doc_id", "phase")


#: Hundredths of the documents' and of the conversations' tokens.
MAIN, ANNEAL, ANNEAL_TASKS, SFT = 55, 12, 20, 60

_PHASES = f"""WITH d AS (SELECT 'doc' AS kind, doc_id AS id, CAST(strlen(text) + 1 AS BIGINT) AS n_tokens, CASE quality WHEN 1 THEN '0' WHEN 0 THEN '1' ELSE '2' END AS best FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
  t AS (SELECT 'task' AS kind, conv_id AS id, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_tokens FROM conversations GROUP BY conv_id),
  b AS (SELECT (SELECT CAST(sum(n_tokens) AS BIGINT) FROM d) AS docs, (SELECT CAST(sum(n_tokens) AS BIGINT) FROM t) AS tasks),
  a AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY best || sha256('anneal:doc:' || id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < docs * {ANNEAL} // 100 AS taken FROM d, b),
  m AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY sha256('main:doc:' || id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < docs * {MAIN} // 100 AS taken_main FROM a WHERE NOT taken),
  x AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY sha256('anneal:task:' || id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < tasks * {ANNEAL_TASKS} // 100 AS taken FROM t, b),
  y AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY sha256('sft:task:' || id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < tasks * {SFT} // 100 AS taken_sft FROM x WHERE NOT taken)
  SELECT kind, id, n_tokens, 'anneal' AS phase FROM a WHERE taken UNION ALL SELECT kind, id, n_tokens, CASE WHEN taken_main THEN 'main' ELSE 'none' END FROM m
  UNION ALL SELECT kind, id, n_tokens, 'anneal' FROM x WHERE taken UNION ALL SELECT kind, id, n_tokens, CASE WHEN taken_sft THEN 'sft' ELSE 'none' END FROM y"""


@query("three_phase_mix", _PHASES)
def three_phase_mix(spark, sf_dir):
    """Documents and conversations dealt to three phases by token budgets."""
    quality = fx.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    size = (F.octet_length("text") + 1).cast("long")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", size.alias("n_tokens")).join(quality, "doc_id", "left").withColumnRenamed("doc_id", "id")
    tasks = fx.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.sum(size).alias("n_tokens"))
    n_docs, n_tasks = (x.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] for x in (docs, tasks))
    return mixture.three_phases(docs, tasks, n_docs * MAIN // 100, n_docs * ANNEAL // 100, n_tasks * ANNEAL_TASKS // 100, n_tasks * SFT // 100)


def _winnowed(words: str, key: str) -> str:
    """SQL of the fingerprints of a table's words, each once."""
    g, w = hygiene.GRAM, hygiene.WINDOW
    return f"""SELECT DISTINCT {key}, f FROM (SELECT {key}, unnest(list_transform(range(1, len(g) - {w - 2}), lambda i: list_min(g[i:i + {w - 1}]))) AS f
      FROM (SELECT {key}, list_transform(range(1, len(w) - {g - 2}), lambda i: substr(md5(array_to_string(w[i:i + {g - 1}], ' ')), 1, 16)) AS g FROM {words} WHERE len(w) >= {g + w - 1}))"""


_WORDS = fx.sql_words(fx.sql_normal("text"))
_SHORT = hygiene.GRAM + hygiene.WINDOW - 2


@query("eval_containment", f"""WITH dw AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents), jw AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
  df AS MATERIALIZED ({_winnowed("dw", "doc_id")}), jf AS MATERIALIZED ({_winnowed("jw", "item_id")}), n AS (SELECT item_id, count(*) AS n FROM jf GROUP BY 1),
  long AS (SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared, CAST(max(n) AS INTEGER) AS n_item FROM df JOIN jf USING (f) JOIN n USING (item_id) GROUP BY 1, 2 HAVING 10 * count(*) >= {hygiene.LEAST_TENTHS} * max(n)),
  s AS (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS t FROM jw WHERE len(w) BETWEEN 1 AND {_SHORT}),
  g AS (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw JOIN (SELECT DISTINCT n FROM s) ON len(w) >= n))
  SELECT * FROM long UNION ALL SELECT DISTINCT doc_id, item_id, 1, 1 FROM g JOIN s USING (n, t)""")  # fmt: skip
def eval_containment(spark, sf_dir):
    """Benchmark items that stand inside longer documents."""
    return hygiene.contained(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), fx.table(spark, sf_dir, "benchmark").select("item_id", "text"))


#: A claim is a first sentence without every fifth word; its evidence is its own text, or for odd ids the text after next.
_CLAIM = f"list_transform(list_filter(list_zip({fx.sql_words("split_part(text, '. ', 1)")}, range(len({fx.sql_words("split_part(text, '. ', 1)")}))), lambda z: z[2] % 5 <> 4), lambda z: z[1])"


@query("entailment", f"""WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w, {fx.sql_words(fx.sql_normal(f"array_to_string({_CLAIM}, ' ')"))} AS c FROM documents),
  n AS (SELECT count(*) AS n FROM w), f AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS word FROM w) GROUP BY 1),
  r AS (SELECT a.doc_id AS id, a.c, b.w AS e, len(a.c) AS m, greatest({entailment.BAND}, CAST(ceil(len(a.c) / 4) AS BIGINT)) AS s FROM w a JOIN w b ON b.doc_id = a.doc_id + CASE WHEN a.doc_id % 2 = 1 THEN 2 ELSE 0 END),
  x AS (SELECT id, word, need, ln((n + 1) / (coalesce(df, 0) + 1)::DOUBLE + 1) AS weight FROM (SELECT id, word, count(*) AS need FROM (SELECT id, unnest(c) AS word FROM r) GROUP BY 1, 2) LEFT JOIN f USING (word), n),
  j AS (SELECT id, m, s, unnest(e) AS word, unnest(range(len(e))) AS j FROM r),
  k AS (SELECT id, word, k, count(*) AS n FROM (SELECT id, word, unnest(range(greatest(0, CAST(floor((j - m) / s) AS BIGINT)), j // s + 1)) AS k FROM j JOIN x USING (id, word)) GROUP BY 1, 2, 3),
  c AS (SELECT id, max(c) AS c FROM (SELECT id, k, sum(least(n, need) * weight) AS c FROM k JOIN x USING (id, word) GROUP BY 1, 2) GROUP BY 1), t AS (SELECT id, sum(need * weight) AS t FROM x GROUP BY 1),
  z AS (SELECT r.id, round(CASE WHEN t IS NOT NULL THEN coalesce(c.c, 0) / t END, 6) AS score FROM r LEFT JOIN t USING (id) LEFT JOIN c USING (id))
  SELECT id, score, coalesce(score >= {entailment.LEAST}::DOUBLE, false) AS entailed FROM z""")  # fmt: skip
def entailment_query(spark, sf_dir):
    """Claims shortened from first sentences, half of them beside evidence of another document."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    bare = F.filter(F.split(F.substring_index("text", ". ", 1), " "), lambda w: w != "")
    claims = d.select(F.col("doc_id").alias("id"), F.array_join(F.filter(bare, lambda w, i: i % 5 != 4), " ").alias("claim"), (F.col("doc_id") + F.when(F.col("doc_id") % 2 == 1, 2).otherwise(0)).alias("doc_id"))
    return entailment.entailed(claims.join(d.select("doc_id", F.col("text").alias("evidence")), "doc_id"), d)


@query("cost_per_verified", fx.gate_sql("SELECT CAST(sum(length(output)) AS BIGINT) AS cost, count(*) FILTER (WHERE v0_pass AND answered) AS verified, round(sum(length(output))::DOUBLE / nullif(count(*) FILTER (WHERE v0_pass AND answered), 0), 6) AS cost_each FROM flags"))
def cost_per_verified(spark, sf_dir):
    rows = validator.checked(gate.outputs(fx.examples(spark, sf_dir), preds=fx.predictions(spark, sf_dir)))
    cost, verified = F.sum(F.length("output")), F.count_if(F.col("v0_failure").isNull() & F.col("_ok"))
    return rows.agg(cost.alias("cost"), verified.alias("verified"), F.round(F.try_divide(cost.cast("double"), verified), 6).alias("cost_each"))


@query("chat_template", """SELECT conv_id, count(*) AS turns, sha256(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS prompt_sha256 FROM conversations GROUP BY 1""")
def chat_template(spark, sf_dir):
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    found = fx.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), turns.alias("t"))
    return found.select("conv_id", "turns", F.sha2(F.array_join(F.transform("t", lambda s: s["line"]), ""), 256).alias("prompt_sha256"))
