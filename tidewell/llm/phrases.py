"""Phrases that belong together, found by suffix sorting.

Every word position starts a suffix of at most MOST words within its piece.  Suffixes are counted where they are
read, shuffled by language and first word, and sorted in reverse; one stack then counts all their prefixes, which are
all the phrases.  A phrase that counts has no word that occurs less often than it must, so such words end a piece: a bit
table of the others (8 MB at most, which may let a rare word pass and stops no other) is sent to all tasks.  First words with more suffixes than a task takes are dealt further by the two
words that follow, so that phrases of three words or more are whole in one task; their pairs travel as suffixes of their own,
one a stretch of text.  Words travel as codes: the CODED most frequent ones at most (a
table that is sent to all tasks) as two or three bytes, others as they are.  No code begins another, so suffixes that
share words stand together in the order of their bytes.

A phrase is scored by its weakest cut, whose parts' counts are joined afterwards.

Defined results: null texts are empty; a null language is ``und``; rows that repeat a doc_id count each; texts
without a word give nothing; other columns are ignored; an empty table gives an empty one.  A text is read in
stretches of about STRETCH bytes that overlap by MOST - 1 words, so it may be of any length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_counted, parallelism, written

MOST = 4
LEAST_COUNT = 30
#: A phrase goes if so many hundredths of its occurrences lie in one longer phrase.
INSIDE_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
#: Codes of the most frequent words: 1,024 of two bytes, the others of three; no longer word gets one.
CODED = 1 << 16
SHORT_CODES = 1 << 10
LONGEST_CODED = 64
MOST_HOT = 1 << 14
#: Languages whose code is one byte.
SHORT_LANGUAGES = 250
#: Bits of the table of words that occur often enough.
MOST_BITS = 1 << 26
#: Rows, and bytes of text, that are cut into words at once.
ROWS_TOGETHER = 1024
STRETCH = 4_000_000
#: Different words that a task counts before it passes them on.
COUNTED_TOGETHER = 250_000
#: Suffixes of a task, and parts into which a language's last sort is dealt.
SUFFIXES_A_TASK = 2_500_000
RANKED_PARTS = 32

#: A-Z to a-z, the marks between pieces to line feeds, tabs to blanks.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_WORD = re.compile(rb" *([^ \n]+)")


def _stretches(texts: list[bytes]) -> Iterator[tuple[list[bytes], int]]:
    """Words of the texts, with a line feed between pieces, and how many of them start suffixes: the rest are seen
    again in the next stretch."""

    def cut(blob: bytes) -> list[bytes]:
        return [w for w in blob.replace(b"\n", b" \n ").split(b" ") if w]

    held, size = [], 0
    for text in texts:
        plain = text.translate(_PLAIN)
        at = 0
        while len(plain) - at > STRETCH:
            end = plain.rfind(b"\n", at, at + STRETCH) + 1 or plain.rfind(b" ", at, at + STRETCH) + 1
            if not end:  # a word as long as a stretch is kept whole
                m = _WORD.match(plain, at)
                end = m.end() if m else at + STRETCH
            own, after, look = cut(plain[at:end]), [], end
            while len(after) < MOST - 1 and (m := _WORD.match(plain, look)):
                after.append(m[1])
                look = m.end()
            yield own + ([] if plain[end - 1 : end] == b"\n" else after), len(own)
            at = end
        held.append(plain[at:] if at else plain)
        size += len(held[-1])
        if size >= STRETCH:
            words = cut(b"\n".join(held))
            yield words, len(words)
            held, size = [], 0
    if held:
        words = cut(b"\n".join(held))
        yield words, len(words)


def _by_language(batches: Iterator) -> Iterator[tuple[str, list[bytes], int]]:
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_TOGETHER):
            part = batch.slice(at, ROWS_TOGETHER)
            langs, texts = part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist()
            for lang in dict.fromkeys(langs):
                for words, own in _stretches([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    yield lang, words, own


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("text IS NOT NULL AND text != ''").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): occurrences of every word; word is binary."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, Counter] = {}

        def told() -> Iterator:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for lang, words, own in _by_language(batches):
            counts = held.setdefault(lang, Counter())
            counts.update(words[:own])
            counts.pop(b"\n", None)
            if sum(map(len, held.values())) > COUNTED_TOGETHER:
                yield from told()
        yield from told()

    return _texts(docs).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame) -> list[bytes]:
    """At most CODED words, the most frequent of all languages first: all above some count."""
    totals = counts.filter(F.octet_length("word") <= LONGEST_CODED).groupBy("word").agg(F.sum("n").alias("n"))
    step = F.floor(F.log2("n") * 8)
    least, held = None, 0
    for r in totals.groupBy(step.alias("k")).agg(F.count("*").alias("c")).orderBy(F.desc("k")).collect():
        if held + r.c > CODED:
            break
        least, held = r.k, held + r.c
    if least is None:
        return []
    return [bytes(r.word) for r in totals.filter(step >= least).orderBy(F.desc("n"), "word").collect()]


def word_hash(lang: str, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(lang.encode() + b"\0"))


def _often(counts: DataFrame) -> np.ndarray:
    """A table of bits, 64 a number, with those of word_hash of all words that occur LEAST_COUNT times or more."""
    known = counts.filter(F.col("n") >= LEAST_COUNT)
    bits = min(MOST_BITS, 1 << (16 * known.count() + (1 << 10)).bit_length())
    slot = F.crc32(F.concat(F.encode("lang", "UTF-8"), F.lit(b"\0"), F.col("word"))) % bits
    rows = known.select(F.floor(slot / 64).cast("int").alias("at"), F.expr("1L").alias("one"), (slot % 64).cast("int").alias("by")).groupBy("at").agg(F.expr("bit_or(shiftleft(one, by))").alias("set")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("set").to_numpy()
    return out


class Codes:
    """Words and languages to codes and back."""

    def __init__(self, frequent: list[bytes], languages: list[str] = ()):
        self.words, self.languages = frequent, languages

    @cached_property
    def short(self) -> dict[str, bytes]:
        return {x: bytes([k + 1]) for k, x in enumerate(self.languages)}

    def language(self, lang: str) -> bytes:
        """Bytes that begin no other language's."""
        return self.short.get(lang) or b"\xff" + lang.encode().replace(b"\0", b"\0\xff") + b"\0\1"

    def split(self, key: bytes) -> tuple[str, int]:
        """The language of a key, and where its suffix begins."""
        if key[0] < 0xFF:
            return self.languages[key[0] - 1], 1
        end = key.index(b"\0\1")
        return key[1:end].replace(b"\0\xff", b"\0").decode(), end + 2

    def _code(self, k: int) -> bytes:
        if k < SHORT_CODES:
            return bytes([0xF8 + (k >> 8), k & 255])
        k -= SHORT_CODES
        return bytes([0xFC + (k >> 16), k >> 8 & 255, k & 255])

    @cached_property
    def table(self) -> dict[bytes, bytes]:
        """Made once in each Python worker, from the words sent."""
        return {w: self._code(k) for k, w in enumerate(self.words)}

    def ends(self, suffix: bytes) -> list[int]:
        """Where each word's code ends."""
        out, at = [], 0
        while at < len(suffix):
            lead = suffix[at]
            at = suffix.index(b" ", at) + 1 if lead < 0xF8 else at + 2 if lead < 0xFC else at + 3
            out.append(at)
        return out

    def phrase(self, suffix: bytes) -> bytes:
        out, at = [], 0
        for end in self.ends(suffix):
            lead = suffix[at]
            if lead < 0xF8:
                out.append(suffix[at : end - 1])
            elif lead < 0xFC:
                out.append(self.words[(lead - 0xF8 << 8) + suffix[at + 1]])
            else:
                out.append(self.words[SHORT_CODES + (lead - 0xFC << 16) + (suffix[at + 1] << 8) + suffix[at + 2]])
            at = end
        return b" ".join(out)


def suffixes(docs: DataFrame, codes, hot, often) -> DataFrame:
    """(bucket, key, n): suffixes of two words or more, counted where they are read; key is the language's code and the
    suffix, bucket is of language and first word, and of the two words that follow where the first is hot; its pairs then have
    rows of their own.  codes, hot, the parts of each (language, first word), and often, the table of _often, are broadcast."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        known, bits = codes.value.table, often.value
        for lang, words, own in _by_language(batches):
            met = [*set(words).difference([b"\n"])]
            salt = zlib.crc32(lang.encode() + b"\0")
            hashes = np.fromiter((zlib.crc32(x, salt) for x in met), np.int64, len(met))
            slot = hashes & (len(bits) * 64 - 1)
            is_often = bits[slot >> 6] >> (slot & 63) & 1
            hashes = np.append(0, hashes[is_often > 0])
            seen = [b"\n", *(x for x, k in zip(met, is_often.tolist(), strict=True) if k)]
            number = dict(zip(met, (np.cumsum(is_often) * is_often).tolist(), strict=True)) | {b"\n": 0}
            w = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            w = np.concatenate([w, np.zeros(MOST, np.int64)])  # 0 ends a piece
            pair = np.where((w[:-1] > 0) & (w[1:] > 0), w[:-1] << 32 | w[1:], w[:-1] << 32)
            pairs, p = np.unique(pair, return_inverse=True)
            whole = (w[:-3] > 0) & (w[1:-2] > 0) & (w[2:-1] > 0)
            quad = (p[:-2] << 32 | np.where(whole, p[2:], 0))[:own]  # the pair at 0 is that of a piece's end
            quads, n = np.unique(quad[(w[:own] > 0) & (w[1 : own + 1] > 0)], return_counts=True)
            if not len(quads):
                continue
            ahead, behind = pairs[quads >> 32], pairs[quads & 0xFFFFFFFF]
            ids = [ahead >> 32, ahead & 0xFFFFFFFF, behind >> 32, behind & 0xFFFFFFFF]
            ids[2] = np.where(ids[1] > 0, ids[2], 0)
            ids[3] = np.where(ids[2] > 0, ids[3], 0)
            parts = np.array([hot.value.get((lang, x), 1) for x in seen])
            is_hot = parts[ids[0]] > 1
            if is_hot.any():
                two, own_n = ahead[is_hot], n[is_hot]  # sorted, as quads are
                first = np.flatnonzero(np.append(True, two[1:] != two[:-1]))
                two, long = two[first], ~is_hot | (ids[2] > 0)
                ids = [np.append(x[long], y) for x, y in zip(ids, (two >> 32, two & 0xFFFFFFFF, two * 0, two * 0), strict=True)]
                n = np.append(n[long], np.add.reduceat(own_n, first))
            coded = pa.array([b"", *(known.get(x) or x + b" " for x in seen[1:])], pa.binary())
            rest = (hashes[ids[1]] * 31 + hashes[ids[2]] * 17) % parts[ids[0]]
            bucket = (hashes[ids[0]] + rest * 0x9E3779B1) & 0xFFFFF
            key = pc.binary_join_element_wise(pa.scalar(codes.value.language(lang), pa.binary()), *(coded.take(pa.array(x)) for x in ids), pa.scalar(b"", pa.binary()))
            for a in range(0, len(n), 100_000):
                b = min(len(n), a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a:b], pa.int32()), key[a:b], pa.array(n[a:b], pa.int64())], ["bucket", "key", "n"])

    return _texts(docs).mapInArrow(run, "bucket int, key binary, n long")


class _Suffixes:
    """Keys of one language in a row: where their words end, and how many words each shares with the key before it."""

    #: Bytes of a key that are compared for many keys at once.
    WIDE = 24

    def __init__(self, data: np.ndarray, offsets: np.ndarray, begin: int):
        start, stop = offsets[:-1], offsets[1:]
        spaces = np.flatnonzero(data == 32)
        at, ends, words = start + begin, [], np.zeros(len(start), np.int64)
        for _ in range(MOST):
            more = at < stop
            lead = data[np.minimum(at, len(data) - 1)]
            after = at + np.where(lead >= 0xFC, 3, 2)
            raw = np.flatnonzero(more & (lead < 0xF8))
            after[raw] = spaces[np.searchsorted(spaces, at[raw])] + 1
            at = np.where(more, after, at)
            words += more
            ends.append(at - start)
        self.ends, self.words = ends, words
        place = start[:, None] + begin + np.arange(self.WIDE)
        bytes_ = np.where(place < stop[:, None], data[np.minimum(place, len(data) - 1)], 0)
        differ = bytes_[1:] != bytes_[:-1]
        equal = begin + np.where(differ.any(axis=1), differ.argmax(axis=1), self.WIDE)
        both = np.minimum(words[1:], words[:-1])
        self.shared = np.zeros(len(start), np.int64)
        for k, end in enumerate(ends):
            self.shared[1:] += (k < both) & (end[1:] <= equal)
        # Keys that are equal as far as that, with words beyond.
        self.unsure = 1 + np.flatnonzero((equal == begin + self.WIDE) & (self.shared[1:] < both))


def _told(data: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """The binary Arrow array of data's bytes from each begin to its end."""
    import pyarrow as pa

    size = end - begin
    to = np.cumsum(size)
    own = data[np.arange(int(to[-1]) if len(to) else 0) - np.repeat(to - size - begin, size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, to).astype(np.int32)), pa.py_buffer(own)])


def _prefixes(sorted_keys: DataFrame, codes, hot) -> DataFrame:
    """(lang, phrase, n): counts, LEAST_COUNT at least, of prefixes of two words or more of suffixes (key, n) in reverse order.

    Keys that share a prefix stand together.  A batch is summed up at once, prefix by prefix; the stack holds the counts so
    far of the prefixes of the key met last, which go on in the next batch or end there.  Of hot first words, other tasks
    have more of a pair's longer suffixes, so pairs are counted by their own rows alone.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, split_key, ends_of = codes.value.table, codes.value.split, codes.value.ends
        split = {codes.value.language(lang) + (table.get(w) or w + b" ") for lang, w in hot.value}
        names, kinds = ["lang", "phrase", "n"], [pa.string(), pa.binary(), pa.int64()]
        stack = [0] * (MOST + 1)  # by number of words; 0 is none
        lang, begin, last, last_ends = None, 0, b"", []
        out: list = []

        def pop(shared: int) -> None:
            """Tells the prefixes that end here, of more than the shared words."""
            rows = [(lang, last[begin : last_ends[d - 1]], stack[d]) for d in range(max(2, shared + 1), MOST + 1) if stack[d] >= LEAST_COUNT]
            stack[shared + 1 :] = [0] * (MOST - shared)
            if rows:
                out.append(pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names))

        for batch in batches:
            keys, counts = batch.column(0), batch.column(1).to_numpy()
            if not len(keys):
                continue
            offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
            data = np.frombuffer(keys.buffers()[2], np.uint8)
            a = 0
            while a < len(keys):
                key = keys[a].as_py()
                own, at = split_key(key)
                b = len(keys)
                if not keys[b - 1].as_py().startswith(key[:at]):  # keys of a language stand together
                    b = a + bisect.bisect_left(range(a, b), True, key=lambda k: not keys[k].as_py().startswith(key[:at]))
                if own != lang:
                    pop(0)
                    lang, begin, last, last_ends = own, at, b"", []
                found = _Suffixes(data, offsets[a : b + 1], begin)
                shared, words, ends, n = found.shared, found.words, found.ends, counts[a:b]
                whole = keys.slice(a, b - a)
                first_ends = [begin + e for e in ends_of(key[begin:])]
                shared[0] = sum(x == y and key[:x] == last[:x] for x, y in zip(first_ends, last_ends, strict=False))
                for k in found.unsure.tolist():
                    one, two = whole[k].as_py(), whole[k - 1].as_py()
                    shared[k] = sum(int(e[k]) == int(e[k - 1]) and one[: int(e[k])] == two[: int(e[k])] for e in ends[: min(words[k], words[k - 1])])
                pop(int(shared[0]))
                is_split = np.zeros(b - a, bool)
                if split:
                    heads = np.flatnonzero(np.append(True, shared[1:] == 0))
                    marks = [whole[int(k)].as_py()[: int(ends[0][k])] in split for k in heads]
                    is_split = np.repeat(marks, np.diff(np.append(heads, b - a)))
                for d in range(2, MOST + 1):
                    have = np.flatnonzero(words >= d)
                    if not len(have):
                        continue
                    heads = np.flatnonzero(np.append(True, shared[have[1:]] < d))
                    sums = np.add.reduceat(np.where(is_split & (words > 2), 0, n)[have] if d == 2 else n[have], heads)
                    if not have[0] and shared[0] >= d:
                        sums[0] += stack[d]
                    stack[d] = 0
                    at = have[heads]
                    if have[-1] == b - a - 1:  # goes on
                        stack[d], sums, at = int(sums[-1]), sums[:-1], at[:-1]
                    kept = sums >= LEAST_COUNT
                    at = at[kept]
                    if len(at):
                        start = offsets[a + at]
                        out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), _told(data, start + begin, start + ends[d - 1][at]), pa.array(sums[kept], pa.int64())], names))
                last = whole[b - a - 1].as_py()
                last_ends = [int(e[-1]) for e in ends[: words[-1]]]
                a = b
            if sum(x.num_rows for x in out) > 50_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out.clear()
        pop(0)
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return sorted_keys.mapInArrow(run, "lang string, phrase binary, n long")


def phrase_counts(docs: DataFrame, counts: DataFrame, a_task: int = SUFFIXES_A_TASK) -> DataFrame:
    """(lang, phrase, words, f): the phrases of at most MOST words that occur LEAST_COUNT times or more, of the word
    counts of the same documents; words is their number."""
    spark = docs.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(parallelism(spark), total // a_task)
    # First words that would fill a task by themselves: MOST_HOT at most.
    fair = max(a_task, total // MOST_HOT)
    hot = spark.sparkContext.broadcast({(r.lang, bytes(r.word)): 2 * (r.n // fair + 1) for r in counts.filter(F.col("n") > fair).collect()})
    languages = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(SHORT_LANGUAGES).collect()
    codes = spark.sparkContext.broadcast(Codes(_frequent(counts), [r.lang for r in languages]))
    often = spark.sparkContext.broadcast(_often(counts))
    dealt = suffixes(docs, codes, hot, often).repartition(tasks, "bucket").select("key", "n").sortWithinPartitions(F.desc("key"))
    found = written(_prefixes(dealt, codes, hot), "prefixes", "zstd")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codes.value
        for batch in batches:
            coded = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(own.phrase, coded), pa.binary()), pa.array([len(own.ends(x)) for x in coded], pa.int32()), batch.column(2)], ["lang", "phrase", "words", "f"])

    named = found.mapInArrow(read, "lang string, phrase binary, words int, f long")
    single = counts.filter(F.col("n") >= LEAST_COUNT).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"))
    return written(named.unionByName(single).select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "f"), "phrases", "zstd")


def _cuts(first_last: str) -> Column:
    """Structs (k, left, right) of a phrase's cuts after its first k words."""
    return F.expr(f"transform(sequence(1, words - 1), k -> struct(k AS k, substring_index({first_last}, ' ', k) AS left, substring_index({first_last}, ' ', k - words) AS right))")


def scored(phrases: DataFrame, chosen: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of chosen phrases (lang, phrase, words, a): the lowest-scoring cut, which is
    the one after fewest words where several are."""
    # A join with counted keys reads its rows three times; each of these stands in a file, so that it is made once.
    cuts = written(chosen.select("*", F.explode(_cuts("phrase")).alias("c")).select("lang", "phrase", "words", "a", "c.*"), "cuts", "zstd")
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = written(join_counted(cuts, part("left", "l"), ["lang", "left"]), "lefts", "zstd")
    cuts = join_counted(cuts, part("right", "r"), ["lang", "right"])
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(8,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    least = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "words")).alias("m"))
    return least.select("lang", "phrase", "m.words", "m.a", "m.l", "m.r", "m.score")


def _inside(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the phrases of two words or more that lie within longer ones, and the most frequent of those."""
    parts = "transform(flatten(transform(sequence(2, words - 1), m -> transform(sequence(0, words - m), i -> struct(i AS i, m AS m)))), x -> array_join(slice(_w, x.i + 1, x.m), ' '))"
    longer = phrases.filter("words > 2").select("lang", "words", "f", F.split("phrase", " ").alias("_w"))
    return longer.select("lang", "f", F.explode(F.expr(f"array_distinct({parts})")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, top: int = TOP, a_task: int = SUFFIXES_A_TASK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases."""
    counts = written(word_counts(docs), "words", "zstd")
    n = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = phrase_counts(docs, counts, a_task)
    several = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    apart = several.join(_inside(phrases), ["lang", "phrase"], "left").filter(F.coalesce(F.col("longest") * 100 < F.col("a") * INSIDE_PERCENT, F.lit(True)))
    kept = scored(phrases, written(apart.drop("longest"), "apart"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's first phrases are among the first of its parts, so no task sorts a whole language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS))
    near = kept.withColumn("_part", part).withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_k") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
