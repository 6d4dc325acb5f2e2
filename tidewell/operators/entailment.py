"""Whether evidence supports a claim: coverage of the claim's words, weighted by how rare they are in a corpus.

A claim of m words is laid along its evidence in windows that start every s = max(BAND, m / 4) words and are m + s words
wide, so that any m neighbouring words lie within one.  In a window a word of the claim is covered as often as it stands
there; the weight of a word is the logarithm of all documents over those that have it.  The score is the weight covered
in the best window over the claim's weight.  An evidence word lies in at most six windows, so work is linear in the texts.

Defined results: a claim without words has no score and is not entailed; evidence without words covers nothing;
an id that repeats has the best score of its rows; rows without an id have no result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import normalize_answer, words

BAND = 8
#: Claims of up to so many words drop other words of their evidence before it is shuffled; the join decides in any case.
LOOKED_UP = 256
#: Scores from here on are support.
LEAST = 0.6


def document_frequencies(corpus: DataFrame) -> DataFrame:
    """(word, df): in how many texts of corpus each normalised word stands."""
    each = corpus.select(F.explode(F.array_distinct(words(normalize_answer(F.col("text"))))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("df"))


def entailed(rows: DataFrame, corpus: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, score, entailed) of rows (id, claim, evidence), with the weights of words taken from corpus (text).

    Words are joined by row and word, so neither a frequent word nor a long text is one key.
    """
    texts = corpus.agg(F.count("*").alias("n"))
    held = rows.filter("id IS NOT NULL").select("id", F.xxhash64("claim", "evidence").alias("_r"), words(normalize_answer(F.col("claim"))).alias("_c"), words(normalize_answer(F.col("evidence"))).alias("_e"))
    m = F.size("_c")
    sized = held.select("*", m.alias("m"), F.greatest(F.lit(BAND), F.ceil(m / 4).cast("int")).alias("s"))
    need = held.select("id", "_r", F.explode("_c").alias("word")).groupBy("id", "_r", "word").agg(F.count("*").alias("need"))
    need = need.join(document_frequencies(corpus), "word", "left")
    need = need.select("id", "_r", "word", "need", F.log((texts.scalar() + 1) / (F.coalesce("df", F.lit(0)) + 1) + 1).alias("weight"))

    placed = F.transform("_e", lambda w, j: F.struct(j.alias("j"), w.alias("word")))
    known = F.when(m <= LOOKED_UP, F.filter(placed, lambda z: F.array_contains(F.col("_c"), z["word"]))).otherwise(placed)
    met = sized.select("id", "_r", "m", "s", F.explode(known).alias("z")).select("id", "_r", "m", "s", "z.j", "z.word").join(need, ["id", "_r", "word"])
    first = F.greatest(F.lit(0), F.floor((F.col("j") - F.col("m")) / F.col("s")).cast("int"))
    windows = F.sequence(first, F.floor(F.col("j") / F.col("s")).cast("int"))
    counted = met.select("id", "_r", "word", "need", "weight", F.explode(windows).alias("k")).groupBy("id", "_r", "word", "k", "need", "weight").agg(F.count("*").alias("n"))
    covered = counted.groupBy("id", "_r", "k").agg(F.sum(F.least("n", "need") * F.col("weight")).alias("c")).groupBy("id", "_r").agg(F.max("c").alias("c"))
    whole = need.groupBy("id", "_r").agg(F.sum(F.col("need") * F.col("weight")).alias("t"))
    scored = whole.join(covered, ["id", "_r"], "left").select("id", F.round(F.coalesce("c", F.lit(0.0)) / F.col("t"), 6).alias("x"))
    best = held.select("id").distinct().join(scored.groupBy("id").agg(F.max("x").alias("score")), "id", "left")
    return best.select("id", "score", F.coalesce(F.col("score") >= least, F.lit(False)).alias("entailed"))
