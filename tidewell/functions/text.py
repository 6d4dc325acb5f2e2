"""Answer normalisation and token overlap as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, in Java's syntax.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"
_WORD = r"[\p{L}\p{N}_]"


def lower(text: Column) -> Column:
    return F.lower(text)


def strip_punctuation(text: Column) -> Column:
    """Deletes the 32 ASCII punctuation marks."""
    return F.regexp_replace(text, r"[!-/:-@\[-`{-~]", "")


def strip_articles(text: Column) -> Column:
    """Puts one blank in place of each whole word a, an or the."""
    return F.regexp_replace(text, rf"(?<!{_WORD})(a|an|the)(?!{_WORD})", " ")


def collapse_white(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, f"{WHITE}+"), lambda z: z != ""), " ")


def normalize_answer(text: Column) -> Column:
    return collapse_white(strip_articles(strip_punctuation(lower(text))))


def words(normalized: Column) -> Column:
    """Tokens of a normalised text; none for an empty one."""
    return F.filter(F.split(normalized, " "), lambda z: z != "")


def blank(text: Column) -> Column:
    """No character but white space."""
    return ~text.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]")


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of words, in time of sorting them.

    Both are sorted together by word, those of a first, and walked once with the words of a that no word of b has
    met yet.
    """
    own = F.transform(a, lambda z: F.struct(z.alias("w"), F.lit(0).alias("side")))
    other = F.transform(b, lambda z: F.struct(z.alias("w"), F.lit(1).alias("side")))

    def step(s: Column, x: Column) -> Column:
        same = s["w"] == x["w"]
        met = same & (s["held"] > 0)
        held = F.when(x["side"] == 0, F.when(same, s["held"]).otherwise(0) + 1).when(met, s["held"] - 1).otherwise(0)
        return F.struct(x["w"].alias("w"), held.alias("held"), F.when((x["side"] == 1) & met, s["n"] + 1).otherwise(s["n"]).alias("n"))

    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("held"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(F.concat(own, other)), start, step, lambda s: s["n"])


def token_f1(pred_words: Column, gold_words: Column) -> Column:
    """F1 of two token arrays: 1 if both are empty, 0 if one is or nothing is shared.

    With c shared tokens, precision c/n and recall c/m, it is 2c / (n + m).
    """
    both = F.size(pred_words) + F.size(gold_words)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * overlap(pred_words, gold_words) / both)


def first_sentence(text: Column) -> Column:
    """Text before the first full stop followed by a blank; all of it if there is none."""
    return F.substring_index(text, ". ", 1)


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes as numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))
