"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become words (runs of letters and digits, lower case; in scripts written without blanks each character is a
word).  Each fixed mask is laid over every word position; the hash of the words it keeps, the others being
ignored, is looked up among the same hashes of the benchmark.  A bit table drops nearly all positions first; an
equi-join of what is left finds the hits.  A position whose seed stands a few words before too (a repeated word or
phrase) is no hit, in documents and items alike, so that repetitions meet once, where they begin, and not each with
each.

Each hit gives a diagonal (document position minus item position).  There the words themselves are compared: an
overlap is a stretch of equal words that ends where MOST_GAP words in a row differ, and it counts with at least
LEAST_WORDS equal words (or LEAST_TENTHS of a shorter item's) and LEAST_TENTHS of its words equal.

Items shorter than the shortest mask are looked up whole, by the hash of all their words.

Defined results: null and blank texts have no words and match nothing; items of the same words are matched once and
all reported; rows that repeat a doc_id are scanned each and reported as one, by the row with the most;
rows without doc_id or item_id are never reported or removed; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written

#: 1: the word counts, 0: it is ignored.
MASKS = ("110111", "1101011")
LEAST_WORDS = 10
LEAST_TENTHS = 7
MOST_GAP = 4
#: A seed that stands up to so many words before as well is a repetition.
REPEATED_WITHIN = 8
#: Bits of the table for each seed of the benchmark, and the logarithms of its least and most bits.  Beyond the most
#: it drops fewer positions and the join gets more, with the same result.
BITS_A_SEED = 512
TABLE_BITS = (22, 27)
#: A seed of more items, or met by more documents, is shared out: so many of each meet under one key of the join.
MET_ITEMS, MET_HITS = 64, 4096
#: Letters of scripts that are written without blanks (Thai, Lao, Burmese, Khmer, kana, Han).
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2FFFF}]"
SHORTEST = min(map(len, MASKS))


def _bare(text: str) -> str:
    """SQL of the words of a text with one blank between."""
    plain = rf"trim(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+', ' '))"
    unspaced = UNSPACED.replace("\\", "\\\\")
    return f"CASE WHEN {text} RLIKE '{unspaced}' THEN trim(regexp_replace(regexp_replace({plain}, '({unspaced})', ' $1 '), ' +', ' ')) ELSE {plain} END"


def _word_hashes(text: str) -> str:
    return f"transform(split({_bare(text)}, ' '), w -> xxhash64(w))"


def _seeds(mask: str) -> str:
    """SQL of the seeds of a mask at all positions of _h."""
    kept = ", ".join(f"get(_h, i + {k})" for k, m in enumerate(mask) if m == "1")
    return f"CASE WHEN size(_h) >= {len(mask)} THEN transform(sequence(0, size(_h) - {len(mask)}), i -> xxhash64({kept})) ELSE CAST(array() AS array<bigint>) END"


def _first_met(seeds: Column, i: Column) -> Column:
    """Whether the seed at i is no repetition."""
    return reduce(and_, (~F.get(seeds, i - p).eqNullSafe(F.get(seeds, i)) for p in range(1, REPEATED_WITHIN + 1)))


def _with_seeds(df: DataFrame, masks: list[str]) -> DataFrame:
    """Adds _s0, _s1 …: the seeds of each mask at each position of _h."""
    return df.select("*", *[F.expr(_seeds(mask)).alias(f"_s{k}") for k, mask in enumerate(masks)])


def _hits(masks: list[str], holds: Callable[[Column], Column] | None = None) -> Column:
    """Structs (mask, pos, seed) of the positions whose seed holds and is no repetition."""

    def of(k: int) -> Column:
        s = F.col(f"_s{k}")
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        kept = F.filter(places, lambda i: (holds(F.get(s, i)) if holds else F.lit(True)) & _first_met(s, i))
        return F.transform(kept, lambda i: F.struct(F.lit(k).alias("mask"), i.alias("pos"), F.get(s, i).alias("seed")))

    return F.concat(*map(of, range(len(masks))))


def distinct_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, _h), the word hashes of items of different words, and (item, item_id), the items that have them."""
    named = benchmark.filter("item_id IS NOT NULL").select("item_id", F.expr(_bare("text")).alias("_t")).filter("_t != ''").select("item_id", F.expr("transform(split(_t, ' '), w -> xxhash64(w))").alias("_h"))
    items = written(named.groupBy("_h").agg(F.min("item_id").alias("item")), "items")
    return items, named.join(items, "_h").select("item", "item_id")


def item_seeds(items: DataFrame) -> tuple[DataFrame, list[str]]:
    """(mask, seed, item, item_pos) of the items, and the masks: the fixed ones, then one for each short length met."""
    short = sorted(r.n for r in items.select(F.size("_h").alias("n")).filter(f"n < {SHORTEST}").distinct().collect())
    masks = [*MASKS, *("1" * n for n in short)]
    # A short item has its own mask alone, and no longer one has it.
    own = " OR ".join([f"(x.mask < {len(MASKS)} AND size(_h) >= {SHORTEST})", *(f"(x.mask = {len(MASKS) + k} AND size(_h) = {n})" for k, n in enumerate(short))])
    found = _with_seeds(items, masks).select("item", "_h", F.monotonically_increasing_id().alias("_row"), F.explode(_hits(masks)).alias("x"))
    return written(found.filter(own).select("x.mask", "x.seed", "item", F.col("x.pos").alias("item_pos")), "item-seeds"), masks


def _probes(seed: Column, bits: int) -> tuple[Column, Column]:
    low = F.lit((1 << bits) - 1).cast("long")
    return seed.bitwiseAND(low), F.shiftright(seed, 32).bitwiseAND(low)


def _bit_table(seeds: DataFrame, bits: int) -> DataFrame:
    """One row: an array of longs with two bits of every seed set."""
    places = seeds.select(F.explode(F.array(*_probes(F.col("seed"), bits))).alias("b"))
    bitmap = places.groupBy(F.expr("CAST(shiftright(b, 6) AS BIGINT)").alias("id")).agg(F.expr("bit_or(shiftleft(1L, CAST(b & 63 AS INT)))").alias("bits"))
    whole = seeds.sparkSession.range(1 << (bits - 6)).join(bitmap, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return whole.agg(F.expr("transform(array_sort(collect_list(struct(id, bits))), x -> x.bits)").alias("table"))


def _islands() -> str:
    """SQL of the overlaps of _h and _ih on the diagonals _d: (doc_word, item_word, n_words, n_equal)."""
    equal = "CASE WHEN least(size(_h), size(_ih) + d) > greatest(0, d) THEN filter(sequence(greatest(0, d), least(size(_h), size(_ih) + d) - 1), p -> get(_h, p) = get(_ih, p - d)) ELSE CAST(array() AS array<int>) END"
    first = f"filter(sequence(0, size(x.e) - 1), k -> k = 0 OR get(x.e, k) - get(x.e, k - 1) > {MOST_GAP})"
    ended = f"transform(filter(transform(_d, d -> struct(d AS d, {equal} AS e)), x -> size(x.e) > 0), x -> struct(x.d AS d, x.e AS e, {first} AS f))"
    until = "coalesce(get(y.f, m + 1), size(y.e))"
    island = f"struct(get(y.e, get(y.f, m)) AS doc_word, get(y.e, get(y.f, m)) - y.d AS item_word, get(y.e, {until} - 1) - get(y.e, get(y.f, m)) + 1 AS n_words, {until} - get(y.f, m) AS n_equal)"
    return f"flatten(transform({ended}, y -> transform(sequence(0, size(y.f) - 1), m -> {island})))"


def _shared_out(hits: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """hits (row, key, pos) and seeds (key, item, item_pos) with the columns i and j, on which, and on key, they join.

    The items of a seed are dealt into parts i of MET_ITEMS and its hits into parts j of MET_HITS, by hash; each hit is
    sent to all i and each item to all j.  Ordinary seeds have one part of each.
    """
    n_hits = hits.groupBy("key").agg(F.count("*").alias("n_hits"))
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    grid = seeds.groupBy("key").agg(F.count("*").alias("n_items")).join(n_hits, "key").select("key", "n_hits", parts("n_items", MET_ITEMS).alias("ni"), parts("n_hits", MET_HITS).alias("nj"))
    grid = written(grid, "seed-grid")
    total = grid.agg(F.coalesce(F.sum("n_hits"), F.lit(0))).first()[0]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = join_hot(hits, grid, "key", "n_hits", total).withColumn("j", F.pmod(F.xxhash64("row", "pos"), F.col("nj")).cast("int"))
    spread = seeds.join(grid, "key").withColumn("i", F.pmod(F.xxhash64("item", "item_pos"), F.col("ni")).cast("int"))
    return dealt.select("row", "pos", "key", every("ni").alias("i"), "j"), spread.select("item", "item_pos", "key", "i", every("nj").alias("j"))


def row_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, doc_word, item_word, n_words, n_equal): verified overlaps, positions from 0; row numbers rows of docs."""
    items, names = distinct_items(benchmark)
    seeds, masks = item_seeds(items)
    bits = max(TABLE_BITS[0], min(TABLE_BITS[1], (BITS_A_SEED * seeds.count()).bit_length()))
    df = docs.filter("doc_id IS NOT NULL").select("doc_id", F.expr(_word_hashes("text")).alias("_h"))
    one = lambda p: F.call_function("shiftright", F.get("_bits", F.shiftright(p, 6).cast("int")), p.cast("int").bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1
    hits = _hits(masks, lambda seed: reduce(and_, map(one, _probes(seed, bits))))
    # The table's column comes last, as it is copied with each row that passes on.
    seeded = _with_seeds(df, masks).withColumn("_bits", _bit_table(seeds, bits).scalar())
    # Spark would move the filter below the columns it uses and repeat their expressions, but for a column beside
    # them that is not deterministic.
    held = written(seeded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "_h", hits.alias("_hits")).filter("row >= 0 AND size(_hits) > 0"), "hits")
    hits = held.select("row", F.explode("_hits").alias("x")).select("row", "x.pos", F.struct("x.mask", "x.seed").alias("key"))
    hits, seeds = _shared_out(hits, seeds.select("item", "item_pos", F.struct("mask", "seed").alias("key")))
    diagonals = hits.join(seeds, ["key", "i", "j"]).select("row", "item", (F.col("pos") - F.col("item_pos")).alias("d"))
    # A document has at most as many diagonals with an item as both have words.
    met = diagonals.groupBy("row", "item").agg(F.collect_set("d").alias("_d"))
    # The document's words come last and are compared in the join's own tasks, not sent on once for each item met.
    met = met.join(items.withColumnRenamed("_h", "_ih"), "item").join(held.select("row", "doc_id", "_h"), "row")
    found = met.select("row", "doc_id", "item", F.size("_ih").alias("_n"), F.explode(F.expr(_islands())).alias("x")).select("row", "doc_id", "item", "_n", "x.*")
    enough = (F.col("n_equal") >= LEAST_WORDS) | (10 * F.col("n_equal") >= LEAST_TENTHS * F.col("_n"))
    found = found.filter(enough & (10 * F.col("n_equal") >= LEAST_TENTHS * F.col("n_words")))
    return found.join(names, "item").select("row", "doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_equal): verified overlaps, positions from 0."""
    return row_overlaps(docs, benchmark).drop("row")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_overlaps, n_equal, n_words): the overlaps of each document with each item; n_equal and n_words are of the longest."""
    per_row = row_overlaps(docs, benchmark).groupBy("row", "doc_id", "item_id").agg(F.count("*").alias("n"), F.max(F.struct("n_equal", "n_words")).alias("b"))
    return per_row.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_overlaps"), F.max("b").alias("b")).select("doc_id", "item_id", "n_overlaps", "b.n_equal", "b.n_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that overlap an item."""
    found = row_overlaps(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
