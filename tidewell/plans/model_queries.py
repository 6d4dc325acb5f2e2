"""Queries of sampling, schedules and dense arithmetic.  Embeddings serve as logits and vectors, events as losses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewell.operators import model, numeric, sampling

from . import fixtures as fx
from .registry import query

DIGITS = 5


def _rounded(c, digits: int = DIGITS):
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def vectors(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def logits(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("seq"), F.posexplode("v").alias("token", "logit"))


V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
LOGITS = f"{V}, l AS (SELECT id AS seq, CAST(i - 1 AS INTEGER) AS token, v[i] AS logit FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM v))"
SOFTMAX = "e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY seq)) AS e FROM {}), p AS (SELECT seq, token, e / sum(e) OVER (PARTITION BY seq) AS p FROM e)"


@query("temperature_scale", f"WITH {LOGITS} SELECT seq, token, round(logit / 0.7::DOUBLE, {DIGITS}) + 0.0 AS logit FROM l")
def temperature_scale(spark, sf_dir):
    return sampling.temperature(logits(spark, sf_dir), 0.7).withColumn("logit", _rounded(F.col("logit")))


@query("topk_logits", f"WITH {LOGITS} SELECT seq, token, logit FROM (SELECT *, rank() OVER (PARTITION BY seq ORDER BY logit DESC) AS r FROM l) WHERE r <= 5")
def topk_logits(spark, sf_dir):
    return sampling.top_k(logits(spark, sf_dir), 5)


@query("softmax_probs", f"WITH {LOGITS}, {SOFTMAX.format('l')} SELECT seq, token, round(p, 6) AS p FROM p")
def softmax_probs(spark, sf_dir):
    return sampling.softmax(logits(spark, sf_dir)).select("seq", "token", F.round("p", 6).alias("p"))


@query("sample_next_token", f"""WITH {LOGITS}, {SOFTMAX.format('l')}, c AS (SELECT seq, token, sum(p) OVER (PARTITION BY seq ORDER BY token) AS c, CAST('0x' || substr(md5('draw:' || seq), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM p)
  SELECT seq, coalesce(min(token) FILTER (WHERE c >= u), max(token)) AS token FROM c GROUP BY seq""")  # fmt: skip
def sample_next_token(spark, sf_dir):
    return sampling.sample(sampling.softmax(logits(spark, sf_dir)), "draw")


STEPS, WARMUP, RATE, LEAST = 6001, 200, 3e-4, 3e-5
DECAY_FROM = 4800


@query("lr_schedule", f"""SELECT it, round(CASE WHEN it < {WARMUP} THEN {RATE}::DOUBLE * (it + 1) / {WARMUP} WHEN it > 6000 THEN {LEAST}::DOUBLE
  ELSE {LEAST}::DOUBLE + 0.5 * (1 + cos(pi() * (it - {WARMUP}) / {6000.0 - WARMUP}::DOUBLE)) * ({RATE}::DOUBLE - {LEAST}::DOUBLE) END, 10) AS lr FROM (SELECT unnest(range({STEPS + 100})) AS it)""")  # fmt: skip
def lr_schedule(spark, sf_dir):
    return spark.range(STEPS + 100).select(F.col("id").alias("it"), F.round(sampling.cosine_rate(F.col("id"), WARMUP, 6000, RATE, LEAST), 10).alias("lr"))


@query("wsd_schedule", f"""SELECT it, round(CASE WHEN it < {WARMUP} THEN {RATE}::DOUBLE * (it + 1) / {WARMUP} WHEN it < {DECAY_FROM} THEN {RATE}::DOUBLE WHEN it <= 6000
  THEN {RATE}::DOUBLE + ({LEAST}::DOUBLE - {RATE}::DOUBLE) * (it - {DECAY_FROM}) / {6000.0 - DECAY_FROM}::DOUBLE ELSE {LEAST}::DOUBLE END, 10) AS lr FROM (SELECT unnest(range({STEPS + 100})) AS it)""")  # fmt: skip
def wsd_schedule(spark, sf_dir):
    return spark.range(STEPS + 100).select(F.col("id").alias("it"), F.round(sampling.plateau_rate(F.col("id"), WARMUP, DECAY_FROM, 6000, RATE, LEAST), 10).alias("lr"))


@query("eval_steps", f"SELECT it FROM (SELECT unnest(range({STEPS})) AS it) WHERE it % 250 = 0")
def eval_steps(spark, sf_dir):
    return spark.range(STEPS).select(F.col("id").alias("it")).filter("it % 250 = 0")


@query("best_checkpoint", """WITH s AS (SELECT event_id // 100 AS step, round(avg(value), 6) AS loss FROM events GROUP BY 1)
  SELECT step, loss, loss < coalesce(min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE) AS improved FROM s""")  # fmt: skip
def best_checkpoint(spark, sf_dir):
    steps = fx.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("step")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return sampling.running_best(steps, "loss", "step")


_SPLIT = "CASE WHEN event_type = 'purchase' THEN 'val' ELSE 'train' END"


@query("mean_loss_by_split", f"SELECT {_SPLIT} AS split, count(*) AS n, round(avg(value), {DIGITS}) AS loss FROM events GROUP BY 1")
def mean_loss_by_split(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").groupBy(F.expr(_SPLIT).alias("split")).agg(F.count("*").alias("n"), F.round(F.avg("value"), DIGITS).alias("loss"))


@query("grad_accum_loss", f"SELECT event_id // 8 AS step, round(sum(value / 8), {DIGITS}) AS loss FROM events GROUP BY 1")
def grad_accum_loss(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 8).alias("step")).agg(F.round(F.sum(F.col("value") / 8), DIGITS).alias("loss"))


_SHAPES = [("wte", [32768, 1024], True), ("wpe", [256, 1024], True), ("attn.qkv.weight", [3072, 1024], True), ("attn.qkv.bias", [3072], True), ("ln.weight", [1024], True), ("ln.bias", [1024], True), ("mlp.weight", [4096, 1024], True), ("buffer", [256, 256], False)]
_VALUES = ", ".join(f"('{n}', {s}, {str(t).lower()})" for n, s, t in _SHAPES)


def _shapes(spark):
    return spark.createDataFrame(_SHAPES, "name string, shape array<int>, trainable boolean")


@query("param_groups", f"SELECT name, CASE WHEN len(shape) >= 2 THEN 'decay' ELSE 'no_decay' END AS grp FROM (VALUES {_VALUES}) s(name, shape, trainable) WHERE trainable")
def param_groups(spark, sf_dir):
    return numeric.decay_groups(_shapes(spark))


@query("param_count", f"SELECT CAST(sum(list_product(shape)) AS BIGINT) AS parameters FROM (VALUES {_VALUES}) s(name, shape, trainable)")
def param_count(spark, sf_dir):
    return numeric.parameter_count(_shapes(spark))


_SUM = "list_sum(list_transform({0}, lambda x: {1}))"


@query("cross_entropy", f"WITH {V} SELECT id, round(ln({_SUM.format('v', 'exp(x - list_max(v))')}) + list_max(v) - v[label % len(v) + 1], {DIGITS}) AS loss FROM v")
def cross_entropy(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.round(numeric.cross_entropy(F.col("v"), F.col("label") % F.size("v")), DIGITS).alias("loss"))


@query("layer_norm", f"""WITH {V}, m AS (SELECT *, list_avg(v) AS m FROM v), s AS (SELECT *, list_avg(list_transform(v, lambda x: (x - m) * (x - m))) AS s FROM m)
  SELECT id, i - 1 AS d, round((v[i] - m) / sqrt(s + 1e-5::DOUBLE), {DIGITS}) + 0.0 AS x FROM (SELECT *, unnest(CAST(range(1, len(v) + 1) AS INTEGER[])) AS i FROM s)""")  # fmt: skip
def layer_norm(spark, sf_dir):
    n = numeric.layer_norm(vectors(spark, sf_dir), "v", "y")
    return n.select("id", F.posexplode("y").alias("d", "x")).withColumn("x", _rounded(F.col("x")))


@query("rms_norm", f"""WITH {LOGITS}, n AS (SELECT *, sqrt(avg(logit * logit) OVER (PARTITION BY seq) + 1e-5::DOUBLE) AS r FROM l) SELECT seq AS id, token AS d, round(logit / r, {DIGITS}) + 0.0 AS x FROM n""")
def rms_norm(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.posexplode(numeric.rms_norm(F.col("v"))).alias("d", "x")).withColumn("x", _rounded(F.col("x")))


@query("swiglu", f"WITH {V} SELECT id, i - 1 AS d, round(v[i] / (1 + exp(-v[i])) * list_reverse(v)[i], {DIGITS}) + 0.0 AS x FROM (SELECT *, unnest(CAST(range(1, len(v) + 1) AS INTEGER[])) AS i FROM v)")
def swiglu(spark, sf_dir):
    y = vectors(spark, sf_dir).select("id", F.posexplode(numeric.swiglu(F.col("v"), F.reverse("v"))).alias("d", "x"))
    return y.withColumn("x", _rounded(F.col("x")))


_TURN = "(id % 97) * pow(10000.0::DOUBLE, -2.0::DOUBLE * ((i - 1) % (len(v) // 2)) / len(v))"


@query("rope", f"""WITH {V} SELECT id, i - 1 AS d, round(CASE WHEN i <= len(v) // 2 THEN v[i] * cos({_TURN}) - v[i + len(v) // 2] * sin({_TURN}) ELSE v[i - len(v) // 2] * sin({_TURN}) + v[i] * cos({_TURN}) END, 4) + 0.0 AS x
  FROM (SELECT *, unnest(CAST(range(1, len(v) + 1) AS INTEGER[])) AS i FROM v)""")  # fmt: skip
def rope(spark, sf_dir):
    y = vectors(spark, sf_dir).select("id", F.posexplode(numeric.rotate(F.col("v"), F.col("id") % 97)).alias("d", "x"))
    return y.withColumn("x", _rounded(F.col("x"), 4))


@query("residual_add", f"WITH {V} SELECT id, i - 1 AS d, round(v[i] + list_reverse(v)[i], {DIGITS}) + 0.0 AS x FROM (SELECT *, unnest(CAST(range(1, len(v) + 1) AS INTEGER[])) AS i FROM v)")
def residual_add(spark, sf_dir):
    y = vectors(spark, sf_dir).select("id", F.posexplode(numeric.add(F.col("v"), F.reverse("v"))).alias("d", "x"))
    return y.withColumn("x", _rounded(F.col("x")))


_ERF = "sign({0}) * CASE WHEN abs({0}) >= 6 THEN 1.0::DOUBLE WHEN {0} = 0 THEN 0 ELSE exp(-{0} * {0}) * list_sum(list_transform(range(120), lambda n: exp((2 * n + 1) * ln(abs({0})) - lgamma(n + 1.5::DOUBLE)))) END"


@query("gelu", f"WITH {LOGITS} SELECT seq AS id, token AS d, round(0.5::DOUBLE * logit * (1 + {_ERF.format('(logit / sqrt(2::DOUBLE))')}), {DIGITS}) + 0.0 AS x FROM l")
def gelu(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.posexplode(numeric.gelu(F.col("v"))).alias("d", "x")).withColumn("x", _rounded(F.col("x")))


@query("grad_clip", f"WITH {LOGITS}, n AS (SELECT sqrt(sum(logit * logit)) AS n FROM l) SELECT seq, token, round(n, {DIGITS}) AS norm, round(logit * least(1.0::DOUBLE, 1.0::DOUBLE / (n + 1e-6::DOUBLE)), 9) + 0.0 AS logit FROM l, n")
def grad_clip(spark, sf_dir):
    c = numeric.clip_by_norm(logits(spark, sf_dir), "logit", 1.0)
    return c.select("seq", "token", F.round("norm", DIGITS).alias("norm"), _rounded(F.col("logit"), 9).alias("logit"))


# Turns of conversations as token sequences: a turn's token is its text's length, folded into the vector table.
_N = "(SELECT count(*) FROM embeddings)"
_EMBED = f"""{V}, turns AS (SELECT conv_id AS seq, turn AS pos, length(text) % {_N} AS token FROM conversations),
em AS (SELECT seq, pos, list_transform(list_zip(a.v, b.v), lambda z: z[1] + z[2]) AS v FROM turns JOIN v a ON a.id = token JOIN v b ON b.id = pos)"""


def _embedded(spark, sf_dir):
    table = vectors(spark, sf_dir).select("id", "v")
    n = fx.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    turns = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.length("text").alias("c"))
    return numeric.embed(turns.select("seq", "pos", (F.col("c") % n.scalar()).alias("token")), table, table)


@query("embedding_lookup", f"WITH {_EMBED} SELECT seq, pos, round(v[1], {DIGITS}) + 0.0 AS first, round(list_sum(v), 4) + 0.0 AS total FROM em")
def embedding_lookup(spark, sf_dir):
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return _embedded(spark, sf_dir).select("seq", "pos", _rounded(F.col("v")[0]).alias("first"), _rounded(total, 4).alias("total"))


@query("causal_attention", f"""WITH {_EMBED}, s AS (SELECT q.seq, q.pos AS qp, k.v, list_dot_product(q.v, k.v) / sqrt(len(q.v)::DOUBLE) AS s FROM em q JOIN em k ON q.seq = k.seq AND k.pos <= q.pos),
  e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, qp)) AS e FROM s), p AS (SELECT *, e / sum(e) OVER (PARTITION BY seq, qp) AS p FROM e)
  SELECT seq, qp AS pos, CAST(i - 1 AS INTEGER) AS d, round(sum(p * v[i]), 4) + 0.0 AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM p) GROUP BY 1, 2, 3""")  # fmt: skip
def causal_attention(spark, sf_dir):
    rows = _embedded(spark, sf_dir).select("seq", "pos", F.col("v").alias("q"), F.col("v").alias("k"), "v")
    return numeric.causal_attention(rows).select("seq", "pos", F.posexplode("out").alias("d", "x")).withColumn("x", _rounded(F.col("x"), 4))


#: Query heads and key heads.
HEADS, SHARED = 4, 2
_UNIT = "list_transform({0}, lambda z: z / sqrt(list_sum(list_transform({0}, lambda y: y * y)) / len({0}) + 1e-5::DOUBLE))"


@query("grouped_query_attention", f"""WITH {_EMBED}, h AS (SELECT seq, pos, head, v[head * (len(v) // {HEADS}) + 1:(head + 1) * (len(v) // {HEADS})] AS x FROM em, (SELECT unnest(range({HEADS})) AS head)),
  q AS (SELECT seq, pos, head, {_UNIT.format('x')} AS q FROM h), k AS (SELECT a.seq, a.pos, a.head, {_UNIT.format('a.x')} AS k, b.x AS v FROM h a JOIN h b ON a.seq = b.seq AND a.pos = b.pos AND b.head = a.head + {HEADS - SHARED} WHERE a.head < {SHARED}),
  s AS (SELECT q.seq, q.pos, q.head, k.v, list_dot_product(q.q, k.k) / sqrt(len(q.q)::DOUBLE) AS s FROM q JOIN k ON q.seq = k.seq AND k.pos <= q.pos AND k.head = q.head // {HEADS // SHARED}),
  e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, pos, head)) AS e FROM s), p AS (SELECT *, e / sum(e) OVER (PARTITION BY seq, pos, head) AS p FROM e)
  SELECT seq, pos, CAST(head AS INTEGER) AS head, CAST(i - 1 AS INTEGER) AS d, round(sum(p * v[i]), 4) + 0.0 AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM p) GROUP BY 1, 2, 3, 4""")  # fmt: skip
def grouped_query_attention(spark, sf_dir):
    """Four query heads of the turns' vectors over two shared key heads, queries and keys of unit mean square."""
    heads = _embedded(spark, sf_dir).select("seq", "pos", numeric.split_heads(F.col("v"), HEADS).alias("h"))
    unit = F.transform("h", lambda h: numeric.rms_norm(h))
    rows = heads.select("seq", "pos", unit.alias("q"), F.slice(unit, 1, SHARED).alias("k"), F.slice("h", HEADS - SHARED + 1, SHARED).alias("v"))
    return numeric.grouped_attention(rows).select("seq", "pos", "head", F.posexplode("out").alias("d", "x")).withColumn("x", _rounded(F.col("x"), 4))


@query("lm_head_logits", f"""WITH {V}, h AS (SELECT label AS seq, list(m ORDER BY i) AS h FROM (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM v) GROUP BY 1, 2) GROUP BY 1)
  SELECT seq, id AS token, round(list_dot_product(h, v), 4) + 0.0 AS logit FROM h JOIN v ON len(h) = len(v)""")  # fmt: skip
def lm_head_logits(spark, sf_dir):
    """Each label's mean vector against the whole tied table."""
    cells = vectors(spark, sf_dir).select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    means = cells.groupBy(F.col("label").alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("h"))
    return numeric.lm_head(means, vectors(spark, sf_dir)).withColumn("logit", _rounded(F.col("logit"), 4))


# A model of one layer and two heads.  Its tables of tokens and positions are the first numbers of the embeddings; its
# other weights are sines of their place, so both engines have them.
TINY = model.Config(vocab_size=64, block_size=8, layers=1, heads=2, width=8)
#: Phase of each matrix.
_PHASES = {"qkv": 1, "attended": 2, "wide": 3, "narrow": 4}


def _tiny(spark, sf_dir, config: model.Config = TINY) -> model.Weights:
    rows = vectors(spark, sf_dir).filter(F.col("id") < config.vocab_size).orderBy("id").collect()
    table = np.array([r.v[: config.width] for r in rows])
    w = model.initial(config) | {"tokens": table, "positions": table[: config.block_size] / 2}
    for name, phase in _PHASES.items():
        for k in range(config.layers):
            n, m = w[f"{k}.{name}.weight"].shape
            w[f"{k}.{name}.weight"] = 0.3 * np.sin(phase + 31.0 * np.arange(n)[:, None] + 17.0 * np.arange(m)[None, :])
    return w


def _sequences(spark, sf_dir, config: model.Config = TINY):
    turns = fx.table(spark, sf_dir, "conversations").filter(F.col("turn") < config.block_size)
    token = (F.length("text") % config.vocab_size).cast("int").alias("token")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", token))), lambda s: s["token"])
    return turns.groupBy(F.col("conv_id").alias("seq")).agg(ordered.alias("ids"))


_D, _HEAD = TINY.width, TINY.width // TINY.heads
_TABLE = f"table_ AS (SELECT vec_id AS id, i - 1 AS d, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, {_D + 1})) AS i FROM embeddings WHERE vec_id < {TINY.vocab_size}))"


def _matrix(name: str, rows: int, columns: int) -> str:
    return f"w_{name} AS (SELECT i, j, 0.3::DOUBLE * sin({_PHASES[name]} + 31.0::DOUBLE * i + 17.0::DOUBLE * j) AS w FROM range({rows}) a(i), range({columns}) b(j))"


def _normed(name: str, source: str) -> str:
    return f"{name} AS (SELECT seq, pos, d, (x - avg(x) OVER p) / sqrt(var_pop(x) OVER p + 1e-5::DOUBLE) AS x FROM {source} WINDOW p AS (PARTITION BY seq, pos))"


def _times(name: str, source: str, matrix: str, of: str = "x") -> str:
    return f"{name} AS (SELECT seq, pos, j AS d, sum({of} * w) AS x FROM {source} JOIN w_{matrix} ON i = d GROUP BY seq, pos, j)"


_FORWARD = f"""{_TABLE}, {_matrix("qkv", _D, 3 * _D)}, {_matrix("attended", _D, _D)}, {_matrix("wide", _D, 4 * _D)}, {_matrix("narrow", 4 * _D, _D)},
  ids AS (SELECT conv_id AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, length(text) % {TINY.vocab_size} AS token FROM conversations WHERE turn < {TINY.block_size}),
  x0 AS (SELECT seq, pos, t.d, t.x + p.x / 2 AS x FROM ids JOIN table_ t ON t.id = token JOIN table_ p ON p.id = pos AND p.d = t.d),
  {_normed("n1", "x0")}, {_times("qkv", "n1", "qkv")},
  parts AS (SELECT seq, pos, d // {_D} AS part, (d % {_D}) // {_HEAD} AS head, d % {_HEAD} AS e, x FROM qkv),
  s AS (SELECT q.seq, q.head, q.pos AS qp, k.pos AS kp, sum(q.x * k.x) / sqrt({_HEAD}::DOUBLE) AS s FROM parts q JOIN parts k ON q.part = 0 AND k.part = 1 AND q.seq = k.seq AND q.head = k.head AND q.e = k.e AND k.pos <= q.pos GROUP BY ALL),
  e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, head, qp)) AS e FROM s), a AS (SELECT *, e / sum(e) OVER (PARTITION BY seq, head, qp) AS p FROM e),
  mixed AS (SELECT a.seq, a.qp AS pos, a.head * {_HEAD} + v.e AS d, sum(a.p * v.x) AS x FROM a JOIN parts v ON v.part = 2 AND v.seq = a.seq AND v.head = a.head AND v.pos = a.kp GROUP BY ALL),
  {_times("att", "mixed", "attended")}, x1 AS (SELECT seq, pos, d, x0.x + att.x AS x FROM x0 JOIN att USING (seq, pos, d)),
  {_normed("n2", "x1")}, {_times("wide", "n2", "wide")}, active AS (SELECT seq, pos, d, 0.5::DOUBLE * x * (1 + {_ERF.format("(x / sqrt(2::DOUBLE))")}) AS x FROM wide),
  {_times("narrow", "active", "narrow")}, x2 AS (SELECT seq, pos, d, x1.x + narrow.x AS x FROM x1 JOIN narrow USING (seq, pos, d)), {_normed("last", "x2")}"""


@query("forward_pass", f"WITH {_FORWARD} SELECT seq, CAST(pos AS INTEGER) AS pos, CAST(id AS INTEGER) AS token, round(sum(last.x * table_.x), 4) + 0.0 AS logit FROM last JOIN table_ USING (d) GROUP BY seq, pos, id")
def forward_pass(spark, sf_dir):
    """Logits of all conversations: tables, attention of two heads, the wide layer, residuals, norms and the tied head."""
    found = model.logits(_sequences(spark, sf_dir), _tiny(spark, sf_dir), TINY)
    return found.select("seq", "pos", F.posexplode("logits").alias("token", "logit")).withColumn("logit", _rounded(F.col("logit"), 4))


#: Without layers the next id hangs on the last one and its place alone, so SQL can list all draws beforehand.
FLAT = model.Config(vocab_size=64, block_size=8, layers=0, heads=2, width=8)
NEW_IDS, TEMPERATURE, TOP_K = 12, 0.8, 5


@query("generate", f"""WITH RECURSIVE {_TABLE}, x0 AS (SELECT t.id AS seq, p.id AS pos, t.d, t.x + p.x / 2 AS x FROM table_ t JOIN table_ p ON p.id < {FLAT.block_size} AND p.d = t.d), {_normed("n", "x0")},
  l AS (SELECT seq AS token, pos, id AS next, sum(n.x * table_.x) / {TEMPERATURE}::DOUBLE AS l FROM n JOIN table_ USING (d) GROUP BY ALL),
  k AS (SELECT *, exp(l - max(l) OVER (PARTITION BY token, pos)) AS e FROM l QUALIFY rank() OVER (PARTITION BY token, pos ORDER BY l DESC) <= {TOP_K}),
  c AS (SELECT token, pos, next, sum(e) OVER (PARTITION BY token, pos ORDER BY next) / sum(e) OVER (PARTITION BY token, pos) AS c FROM k),
  g AS (SELECT conv_id AS seq, 0 AS step, CASE WHEN conv_id % 5 = 0 THEN [0] ELSE list(CAST(length(text) % {FLAT.vocab_size} AS INTEGER) ORDER BY turn) END AS ids FROM conversations WHERE turn < {FLAT.block_size} GROUP BY conv_id
    UNION ALL SELECT seq, step + 1, list_append(ids, CAST(next AS INTEGER)) FROM (SELECT g.seq, g.step, g.ids, min(c.next) AS next FROM g JOIN c ON c.token = g.ids[-1] AND c.pos = least(len(g.ids), {FLAT.block_size}) - 1
      AND c.c >= CAST('0x' || substr(md5('draw:' || g.seq || ':' || g.step), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE WHERE g.step < {NEW_IDS} GROUP BY g.seq, g.step, g.ids))
  SELECT seq, array_to_string(ids, ' ') AS ids FROM g WHERE step = {NEW_IDS}""")  # fmt: skip
def generate(spark, sf_dir):
    """Twelve ids after each conversation; a fifth of the prompts is empty and starts from the end-of-text id."""
    prompts = _sequences(spark, sf_dir, FLAT).select("seq", F.when(F.col("seq") % 5 != 0, F.col("ids")).alias("ids"))
    found = model.generate(prompts, _tiny(spark, sf_dir, FLAT), FLAT, NEW_IDS, TEMPERATURE, TOP_K, "draw")
    return found.select("seq", F.array_join("ids", " ").alias("ids"))
