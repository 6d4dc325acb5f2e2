"""Held-out texts inside longer documents, by winnowed fingerprints.

A fingerprint is a hash of GRAM words of the normalised text; of each WINDOW of neighbours the least is kept.  Windows that lie
within an item lie, whole, in every document that holds it, so all the item's fingerprints stand in that document whatever is
around it.  Items too short for a window are looked up by the hash of all their words.

An item is met by its rarest fingerprints only: if a document holds LEAST_TENTHS of them, it holds one of the
n - ceil(LEAST_TENTHS * n / 10) + 1 that fewest items have.  A phrase that many items share is thus no key of the join,
unless an item has nothing else.  Whole arrays are compared afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import normalize_answer, words

GRAM = 8
WINDOW = 4
LEAST_TENTHS = 8


def _hash(grams: str) -> str:
    return f"substr(md5({grams}), 1, 16)"


def fingerprints(words_: str) -> Column:
    """The winnowed fingerprints of an array of words, each once; none for fewer than GRAM + WINDOW - 1 words."""
    grams = f"transform(sequence(1, size(w) - {GRAM - 1}), i -> {_hash(f'''array_join(slice(w, i, {GRAM}), ' ')''')})"
    least = f"array_distinct(transform(sequence(1, size(g) - {WINDOW - 1}), i -> array_min(slice(g, i, {WINDOW}))))"
    # Arrays of one hold what inner functions read many times, so that it is computed once.
    long = f"transform(filter(array({words_}), w -> size(w) >= {GRAM + WINDOW - 1}), w -> {grams})"
    return F.expr(f"flatten(transform({long}, g -> {least}))")


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): the items (item_id, text) that documents (doc_id, text) hold, with the fingerprints shared.

    Rows without an id and texts without words hold and are held by nothing.
    """
    d = docs.filter("doc_id IS NOT NULL").select("doc_id", words(normalize_answer(F.col("text"))).alias("_w"))
    i = items.filter("item_id IS NOT NULL").select("item_id", words(normalize_answer(F.col("text"))).alias("_w")).filter("size(_w) > 0")
    own = i.select("item_id", "_w", fingerprints("_w").alias("_f"))
    winnowed = own.filter("size(_f) > 0").select("item_id", "_f")
    # Items of the same fingerprints are met once.
    kinds = winnowed.groupBy("_f").agg(F.min("item_id").alias("kind"))
    each = kinds.select("kind", F.size("_f").alias("n"), F.explode("_f").alias("f"))
    often = each.groupBy("f").agg(F.count("*").alias("items"))
    ranked = each.join(often, "f").groupBy("kind").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("items", "f"))).alias("r"))
    rare = F.expr(f"slice(r, 1, n - CAST(ceil({LEAST_TENTHS} * n / 10D) AS INT) + 1)")
    keys = ranked.select("kind", F.explode(F.transform(rare, lambda x: x["f"])).alias("f"))
    marked = d.select("doc_id", fingerprints("_w").alias("_df"))
    met = marked.select("doc_id", "_df", F.explode("_df").alias("f")).join(keys, "f").dropDuplicates(["doc_id", "kind", "_df"])
    shared = met.join(kinds, "kind").select("doc_id", "kind", "_f", F.size(F.array_intersect("_df", "_f")).alias("n_shared"), F.size("_f").alias("n_item"))
    held = shared.filter(f"10 * n_shared >= {LEAST_TENTHS} * n_item").groupBy("doc_id", "_f").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    long = held.join(winnowed, "_f").select("doc_id", "item_id", "n_shared", "n_item")

    # Short items: all stretches of their lengths, of which there are fewer than GRAM + WINDOW - 1.
    whole = own.filter("size(_f) = 0").select("item_id", F.size("_w").alias("n"), F.md5(F.array_join("_w", " ")).alias("h"))
    lengths = whole.agg(F.array_sort(F.collect_set("n")).alias("l"))
    of = "transform(filter(l, n -> n <= size(w)), n -> transform(sequence(1, size(w) - n + 1), i -> md5(array_join(slice(w, i, n), ' '))))"
    stretches = f"array_distinct(flatten(flatten(transform(array(_w), w -> {of}))))"
    found = d.withColumn("l", lengths.scalar()).select("doc_id", F.explode(F.expr(stretches)).alias("h")).join(whole, "h")
    short = found.select("doc_id", "item_id", F.lit(1).alias("n_shared"), F.lit(1).alias("n_item")).distinct()
    return long.unionByName(short)


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold an item."""
    return docs.join(contained(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
