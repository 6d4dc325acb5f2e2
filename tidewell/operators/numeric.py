"""Dense vector arithmetic over array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def layer_norm(df: DataFrame, column: str, out: str, eps: float = 1e-5) -> DataFrame:
    """Adds the vector with mean 0 and variance 1.

    Mean and deviation reach the lambdas as arrays: a column used once in a lambda would be computed anew there
    for every element.
    """
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    mean = F.array_repeat(total(F.col(column)) / F.size(column), F.size(column))
    df = df.withColumn("_c", F.zip_with(column, mean, lambda x, m: x - m))
    deviation = F.sqrt(total(F.transform("_c", lambda x: x * x)) / F.size("_c") + eps)
    return df.withColumn(out, F.zip_with("_c", F.array_repeat(deviation, F.size("_c")), lambda x, d: x / d)).drop("_c")


def rms_norm(vector: Column, eps: float = 1e-5) -> Column:
    """The vector over the root of its mean square."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x) / F.size(vector)
    return F.zip_with(vector, F.array_repeat(F.sqrt(square + eps), F.size(vector)), lambda x, r: x / r)


def swiglu(gate: Column, value: Column) -> Column:
    """gate * sigmoid(gate) * value, element by element."""
    return F.zip_with(gate, value, lambda g, v: g / (1 + F.exp(-g)) * v)


def rotate(vector: Column, pos: Column, base: float = 10000.0) -> Column:
    """Rotary positions: element k and its partner half the width on turn by pos * base^(-2k / width)."""
    half = (F.size(vector) / 2).cast("int")
    places = F.transform(F.array_repeat(pos.cast("double"), half), lambda p, k: p * F.pow(F.lit(base), -2.0 * k / (2 * half)))
    pairs = F.arrays_zip(F.slice(vector, F.lit(1), half).alias("a"), F.slice(vector, half + 1, half).alias("b"), places.alias("t"))
    first = F.transform(pairs, lambda z: z["a"] * F.cos(z["t"]) - z["b"] * F.sin(z["t"]))
    second = F.transform(pairs, lambda z: z["a"] * F.sin(z["t"]) + z["b"] * F.cos(z["t"]))
    return F.concat(first, second)


def cross_entropy(logits: Column, target: Column) -> Column:
    """logsumexp(logits) less the target's logit; target counts from 0."""
    top = F.array_max(logits)
    return F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top - F.element_at(logits, target + 1)


#: Terms of the error function's series, enough for all |x| below ERF_ONE; from there on it is 1 to double precision.
ERF_TERMS, ERF_ONE = 120, 6.0
_ERF = [1 / math.gamma(n + 1.5) for n in range(ERF_TERMS)]


def erf(x: Column) -> Column:
    """The error function: exp(-x^2) times the sum of x^(2n+1) / gamma(n + 3/2), all terms of one sign."""
    most = F.least(F.abs(x), F.lit(ERF_ONE))
    series = F.aggregate(F.array(*map(F.lit, reversed(_ERF))), F.lit(0.0), lambda s, c: s * most * most + c)
    return F.signum(x) * F.when(most >= ERF_ONE, 1.0).otherwise(F.exp(-most * most) * most * series)


def gelu(vector: Column) -> Column:
    """x * Phi(x) of every element."""
    return F.transform(vector, lambda x: 0.5 * x * (1 + erf(x / math.sqrt(2))))


def embed(tokens: DataFrame, table: DataFrame, positions: DataFrame) -> DataFrame:
    """(seq, pos, v): each token's vector plus its position's."""
    by_token = table.select(F.col("id").alias("token"), F.col("v").alias("tv"))
    by_pos = positions.select(F.col("id").alias("pos"), F.col("v").alias("pv"))
    return tokens.join(by_token, "token").join(by_pos, "pos").select("seq", "pos", add(F.col("tv"), F.col("pv")).alias("v"))


#: Positions a tile, and tiles a strip of queries.
TILE, STRIP = 64, 16


def split_heads(vector: Column, heads: int) -> Column:
    """The vector cut into so many heads of one width."""
    width = (F.size(vector) / heads).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(vector, h * width + 1, width))


def _partial(query: Column, keys: Column) -> Column:
    """(m, s, o) of a query (pos, q) over a tile of keys (pos, k, v): the largest score, the sum of exp(score - m), and
    the sum of exp(score - m) times v; null if the query sees no key of the tile."""
    seen = F.filter(keys, lambda k: k["pos"] <= query["pos"])
    scored = F.transform(seen, lambda k: F.struct((dot(query["q"], k["k"]) / F.sqrt(F.size(query["q"]).cast("double"))).alias("x"), k["v"].alias("v")))
    # Arrays of one hold what later functions read for every element, so that it is computed once.
    topped = F.transform(F.array(scored), lambda r: F.struct(r.alias("r"), F.array_max(F.transform(r, lambda z: z["x"])).alias("m")))
    weighed = F.transform(topped, lambda t: F.struct(t["m"].alias("m"), F.transform(t["r"], lambda z: F.struct(F.exp(z["x"] - t["m"]).alias("e"), z["v"].alias("v"))).alias("r")))
    zero = F.transform(F.get(keys, F.lit(0))["v"], lambda x: F.lit(0.0))
    summed = F.transform(
        weighed,
        lambda t: F.struct(
            t["m"].alias("m"),
            F.aggregate(t["r"], F.lit(0.0), lambda s, z: s + z["e"]).alias("s"),
            F.aggregate(t["r"], zero, lambda o, z: F.zip_with(o, z["v"], lambda a, x: a + z["e"] * x)).alias("o"),
        ),
    )
    return F.when(F.exists(keys, lambda k: k["pos"] <= query["pos"]), F.get(summed, F.lit(0)))


def _merged(a: Column, b: Column) -> Column:
    """Two partial results of one query as one; either may be null.  The order of merging does not matter."""
    m = F.greatest(a["m"], b["m"])
    both = F.transform(
        F.array(F.struct(F.exp(a["m"] - m).alias("fa"), F.exp(b["m"] - m).alias("fb"))),
        lambda f: F.struct(m.alias("m"), (a["s"] * f["fa"] + b["s"] * f["fb"]).alias("s"), F.zip_with(a["o"], b["o"], lambda x, y: x * f["fa"] + y * f["fb"]).alias("o")),
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.get(both, F.lit(0)))


def grouped_attention(rows: DataFrame, tile: int = TILE, strip: int = STRIP) -> DataFrame:
    """(seq, pos, head, out) of rows (seq, pos, q, k, v): causal attention by tiles.

    q has a vector a query head, k and v have a vector a key head; the query heads share the key heads in groups of
    neighbours.  Positions are cut into tiles; a tile of queries meets a tile of keys as one row, which gives each query
    a running maximum, a sum and a vector, and these are merged.  No row stands for a pair of positions.  A strip of
    query tiles is the key of the join, so a long sequence is shared out among tasks, its keys copied once a strip.

    Rows without seq, pos or vectors are left out; rows that repeat a position see one another and have a result each.
    """
    held = rows.filter("seq IS NOT NULL AND pos IS NOT NULL AND q IS NOT NULL AND k IS NOT NULL AND v IS NOT NULL").withColumn("t", F.floor(F.col("pos") / tile))
    group = (F.size("q") / F.size("k")).cast("int")
    queries = held.select("seq", "t", "pos", group.alias("g"), F.posexplode("q").alias("head", "q"))
    queries = queries.groupBy("seq", "t", "head", F.floor(F.col("head") / F.col("g")).cast("int").alias("kv")).agg(F.array_sort(F.collect_list(F.struct("pos", "q"))).alias("qs"))
    queries = queries.withColumn("strip", F.floor(F.col("t") / strip))
    keys = held.select("seq", "t", "pos", F.posexplode(F.arrays_zip("k", "v")).alias("kv", "z"))
    keys = keys.groupBy("seq", "t", "kv").agg(F.collect_list(F.struct("pos", "z.k", "z.v")).alias("ks"))
    last = held.groupBy("seq").agg(F.floor(F.max("t") / strip).alias("last"))
    sent = keys.join(last, "seq").select("seq", F.col("t").alias("kt"), "kv", "ks", F.explode(F.sequence(F.floor(F.col("t") / strip), F.col("last"))).alias("strip"))
    met = queries.join(sent, ["seq", "strip", "kv"]).filter("kt <= t")
    parts = met.select("seq", "t", "head", F.transform("qs", lambda q: q["pos"]).alias("ps"), "kt", F.transform("qs", lambda q: _partial(q, F.col("ks"))).alias("r"))
    # A tile of queries has one row a tile of keys, in the same order of queries.
    gathered = parts.groupBy("seq", "t", "head", "ps").agg(F.collect_list("r").alias("rs"))
    whole = F.aggregate(F.slice("rs", F.lit(2), F.size("rs")), F.get("rs", F.lit(0)), lambda a, b: F.zip_with(a, b, _merged))
    each = gathered.select("seq", "head", F.explode(F.arrays_zip(F.col("ps").alias("pos"), whole.alias("x"))).alias("z"))
    return each.select("seq", F.col("z.pos").alias("pos"), "head", F.transform(F.col("z.x.o"), lambda o: o / F.col("z.x.s")).alias("out"))


def causal_attention(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(seq, pos, out) of rows (seq, pos, q, k, v), one vector each: each position sees itself and those before it."""
    return grouped_attention(rows.select("seq", "pos", F.array("q").alias("q"), F.array("k").alias("k"), F.array("v").alias("v")), tile).drop("head")


#: Rows of the tied table that one block of it holds.
HEAD_BLOCK = 1024


def lm_head(hidden: DataFrame, table: DataFrame, block: int = HEAD_BLOCK) -> DataFrame:
    """(seq, token, logit): every hidden vector against every vector of the tied table; dense by nature.

    The table is dealt into blocks of some block rows; each hidden vector goes to every block once, by the block's
    number, and meets all its rows there.
    """
    n = table.count()
    blocks = max(1, -(-n // block))
    dealt = table.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct(F.col("id").alias("token"), "v")).alias("rows"))
    sent = hidden.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    each = sent.join(dealt, "b").select("seq", "h", F.explode("rows").alias("r"))
    return each.select("seq", "r.token", dot(F.col("h"), F.col("r.v")).alias("logit"))


def clip_by_norm(rows: DataFrame, value: str, limit: float) -> DataFrame:
    """Scales value so that the root of its sum of squares is at most limit."""
    norm = rows.agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    return rows.withColumn("norm", norm.scalar()).withColumn(value, F.col(value) * F.least(F.lit(1.0), F.lit(limit) / (F.col("norm") + 1e-6)))


def parameter_count(shapes: DataFrame) -> DataFrame:
    return shapes.agg(F.sum(F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)).alias("parameters"))


def decay_groups(shapes: DataFrame) -> DataFrame:
    """(name, grp): trainable parameters of two or more dimensions decay."""
    return shapes.filter("trainable").select("name", F.when(F.size("shape") >= 2, "decay").otherwise("no_decay").alias("grp"))
