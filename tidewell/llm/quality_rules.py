"""Line-first quality rules, in DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a
document that loses too much of its text that way is rejected, besides those that fail the base limits.

Defined results: a null text is an empty one (no words, so it fails the base limits); lines without a word
are neither judged nor counted as lost; rows with the same doc_id are judged one by one; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, split_words

SYMBOLS = "#*$%&|<>"
#: Marks of a line that is page furniture or a legal notice.
BOILERPLATE = (
    r"(?i)all rights reserved|cookie|privacy policy|terms of (?:use|service)|javascript|subscribe|newsletter|"
    r"click here|read more|sign (?:in|up)\b|log ?in\b|lorem ipsum|share (?:this|on)\b|skip to content|copyright|"
    r"licen[sc]ed under|released under"
)
NAVIGATION = r"[|»›>•·].*[|»›>•·].*[|»›>•·]|^\W*(?i:home|menu|search|next|previous|back|top|contact|about)\W*$"
#: A line of more words is text: such marks fail it only where they are a large share of it.
SHORT_LINE = 20
#: Per cent of a longer line's characters that boilerplate must hold.
LEAST_BOILERPLATE = 20
#: Words of a longer line for each separator, at most.
MOST_BETWEEN = 8
#: BOILERPLATE as whole words, or their usual endings.
_BOILER_WORDS = BOILERPLATE.replace("(?i)", r"(?i)(?<![\p{L}\p{N}])(?:") + r")(?:ed|rs?|d|s)?(?![\p{L}\p{N}])"
#: Symbols and repeated marks that a line may have for each hundred words.
MOST_MARKS = 20
#: Per cent of a document's characters that its failing lines may hold.
MOST_LOST = 30
WINDOW = 8


def _window_hash(words: str) -> str:
    return f"xxhash64({', '.join(f'get({words}, i + {k})' for k in range(WINDOW))})"


def line_fails(line: Column) -> Column:
    """Whether a line fails a rule; false for a line without a word."""
    n_words = F.regexp_count(line, F.lit(f"[^{SPACE}]+"))
    marks = F.length(F.regexp_replace(line, r"[^#*$%&|<>!?]+", ""))
    bangs = F.regexp_count(line, F.lit(r"[!?]{2,}"))
    single = F.regexp_count(line, F.lit(r"[!?]"))
    punctuation = ((marks - single + bangs) * 100 > MOST_MARKS * n_words) | ~line.rlike(r"\p{L}")
    # Most letters must be capitals: scripts without case have neither kind.
    capitals, letters = F.length(F.regexp_replace(line, r"\P{Lu}+", "")), F.length(F.regexp_replace(line, r"\P{L}+", ""))
    shouted = (n_words >= 5) & ~line.rlike(r"\p{Ll}") & (2 * capitals > letters)
    return (n_words > 0) & (punctuation | _navigation(line, n_words) | shouted | _boilerplate(line, n_words))


def _boilerplate(line: Column, n_words: Column) -> Column:
    # The plain pattern comes first, as it drops nearly all lines.
    share = 100 * (F.length(line) - F.length(F.regexp_replace(line, _BOILER_WORDS, ""))) >= LEAST_BOILERPLATE * F.length(line)
    return line.rlike(BOILERPLATE) & line.rlike(_BOILER_WORDS) & ((n_words <= SHORT_LINE) | share)


def _navigation(line: Column, n_words: Column) -> Column:
    dense = F.length(F.regexp_replace(line, r"[^|»›>•·]+", "")) * MOST_BETWEEN >= n_words
    return line.rlike(NAVIGATION) & ((n_words <= SHORT_LINE) | dense)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def clean_text(text: Column) -> Column:
    """The text without its failing lines; null stays null."""
    return F.when(text.isNotNull(), F.array_join(F.filter(_lines(text), lambda x: ~line_fails(x)), "\n"))


def _prefix(docs: DataFrame) -> str:
    """What no column of docs begins with, for working columns beside them."""
    out = "_q_"
    while any(c.lower().startswith(out) for c in docs.columns):
        out = f"_{out}"
    return out


def _measured(docs: DataFrame, text: str, q: str) -> DataFrame:
    """Adds the columns of the rules under names with q in front."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn(f"{q}h", F.transform(split_words(t), lambda w: F.xxhash64(w)))
    df = df.withColumn(f"{q}n_words", F.size(f"{q}h").cast("long"))
    windows = f"CASE WHEN size({q}h) >= {WINDOW} THEN transform(sequence(0, size({q}h) - {WINDOW}), i -> {_window_hash(f'{q}h')}) END"
    df = df.withColumn(f"{q}win", F.expr(windows)).drop(f"{q}h")
    df = df.withColumn(f"{q}dup", F.expr(f"coalesce(size(array_distinct({q}win)) < size({q}win), false)"))
    # Only documents that repeat a window pay for the sort.
    df = df.withColumn(f"{q}sorted", F.expr(f"CASE WHEN {q}dup THEN array_sort(transform({q}win, (x, i) -> struct(x AS h, i AS i))) END")).drop(f"{q}win")
    twice = f"(j > 0 AND get({q}sorted, j).h = get({q}sorted, j - 1).h) OR (j + 1 < size({q}sorted) AND get({q}sorted, j).h = get({q}sorted, j + 1).h)"
    df = df.withColumn(f"{q}pos", F.expr(f"CASE WHEN {q}dup THEN array_sort(transform(filter(sequence(0, size({q}sorted) - 1), j -> {twice}), j -> get({q}sorted, j).i)) END")).drop(f"{q}sorted")
    covered = f"aggregate(sequence(0, size({q}pos) - 1), 0L, (a, j) -> a + least({WINDOW}, coalesce(get({q}pos, j + 1) - get({q}pos, j), {WINDOW})))"
    df = df.withColumn(f"{q}repeat", F.expr(f"CASE WHEN {q}dup THEN {covered} ELSE 0L END")).drop(f"{q}pos", f"{q}dup")
    df = df.withColumn(f"{q}lines", F.filter(_lines(F.col(text)), lambda x: x.rlike(f"[^{SPACE}]")))
    return df.select(
        *docs.columns,
        F.monotonically_increasing_id().alias(f"{q}row"),
        f"{q}n_words",
        F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("long").alias(f"{q}word_chars"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias(f"{q}n_symbols"),
        (F.size(f"{q}lines") - F.size(F.array_distinct(f"{q}lines"))).cast("long").alias(f"{q}n_dup_lines"),
        F.col(f"{q}repeat").alias(f"{q}n_repeat_words"),
        F.aggregate(f"{q}lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias(f"{q}all_chars"),
        F.aggregate(f"{q}lines", F.lit(0).cast("long"), lambda a, x: a + F.when(line_fails(x), F.length(x)).otherwise(0)).alias(f"{q}lost_chars"),
    )


def _base_failed(q: str) -> Column:
    # Spark moves a filter below the columns it uses and repeats their expressions there, many times over; it
    # leaves it above a column that is not deterministic, as the row number (never negative) is.
    return (F.col(f"{q}row") < 0) | (F.col(f"{q}n_words") < 20) | (100 * F.col(f"{q}n_repeat_words") > 30 * F.col(f"{q}n_words"))


def _kept(q: str, most_lost: int) -> Column:
    return ~_base_failed(q) & (100 * F.col(f"{q}lost_chars") <= most_lost * F.col(f"{q}all_chars"))


def judge(docs: DataFrame, text: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept.

    docs must not have columns of these names; select what is needed first.
    """
    q = _prefix(docs)
    measures = [F.col(f"{q}{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")]
    return _measured(docs, text, q).select(*docs.columns, *measures, _base_failed(q).alias("base_failed"), _kept(q, most_lost).alias("kept"))


def clean(docs: DataFrame, most_lost: int = MOST_LOST) -> DataFrame:
    """The documents that are kept, without their failing lines; n_chars, where there is one, is the new length."""
    q = _prefix(docs)
    df = _measured(docs, "text", q).filter(_kept(q, most_lost))
    df = df.withColumn("text", F.when(F.col(f"{q}lost_chars") > 0, clean_text(F.col("text"))).otherwise(F.col("text"))).select(*docs.columns)
    return df.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else df


def quality(docs: DataFrame) -> DataFrame:
    """The digest of every document."""
    return judge(docs.select("doc_id", "text")).drop("text")
