"""Byte-pair encoding: pre-tokenization, counts, merges, training, encoding and decoding."""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The pieces of byte-level pre-tokenization with each digit by itself.
PIECES = r"(?U)\p{N}|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?[^\s\p{L}\p{N}]+|\s+(?![^\s\p{N}])|\s+"
#: Special tokens by id.
SPECIALS = ("<|endoftext|>", "<|pad|>", "<|im_start|>", "<|im_end|>")


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def word_counts(docs: DataFrame) -> DataFrame:
    """(piece, cnt) over all documents."""
    return docs.select(F.explode(pieces(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("cnt"))


def pair_counts(tokens: DataFrame) -> DataFrame:
    """(a, b, cnt, first_pos) of neighbours in token rows (seq, pos, token), overlapping ones too."""
    after = F.lead("token").over(Window.partitionBy("seq").orderBy("pos"))
    pairs = tokens.select("pos", F.col("token").alias("a"), after.alias("b")).filter("b IS NOT NULL")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))


#: Ids, of one array or several, that a task works on at once, and rows that it encodes or decodes at once.
IDS_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 512


def _few_rows(batches: Iterator) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def pair_counts_of(arrays: DataFrame, at_once: int = IDS_AT_ONCE) -> DataFrame:
    """(a, b, cnt, first_pos) of neighbours in id arrays (ids).  Each task counts its own arrays, in stretches of
    at_once, and only the pairs' counts are shuffled."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def summed(keys, n, first):
            order = np.lexsort((first, keys))
            keys, n, first = keys[order], n[order], first[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            return keys[at], np.add.reduceat(n, at) if len(at) else n, first[at]

        def told(held):
            keys, n, first = held
            return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32)), pa.array(n), pa.array(first.astype(np.int32))], ["a", "b", "cnt", "first_pos"])

        none = (np.zeros(0, np.int64),) * 3
        held = none
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            offsets = column.offsets.to_numpy().astype(np.int64)
            ids = column.values.to_numpy(zero_copy_only=False)
            lasts = np.unique(offsets[1:] - 1)
            for low in range(int(offsets[0]), int(offsets[-1]) - 1, at_once):
                at = np.arange(low, min(low + at_once, int(offsets[-1]) - 1))
                at = at[lasts[np.minimum(np.searchsorted(lasts, at), len(lasts) - 1)] != at]
                keys = ids[at].astype(np.int64) << 32 | ids[at + 1].astype(np.int64) & 0xFFFFFFFF
                own = (keys, np.ones(len(at), np.int64), at - offsets[np.searchsorted(offsets, at, side="right") - 1])
                held = summed(*(np.concatenate(x) for x in zip(held, summed(*own), strict=True)))
                if len(held[0]) > at_once:
                    yield told(held)
                    held = none
        yield told(held)

    found = arrays.filter("size(ids) > 1").select(F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "a int, b int, cnt long, first_pos int")
    return found.groupBy("a", "b").agg(F.sum("cnt").alias("cnt"), F.min("first_pos").alias("first_pos"))


def first_of(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of several the one that comes first."""
    return pairs.orderBy(F.desc("cnt"), "first_pos", "a", "b").limit(1)


def best_pair(tokens: DataFrame) -> DataFrame:
    return first_of(pair_counts(tokens))


def merge(ids: Column, left: int, right: int, new_id: int) -> Column:
    """An id array with each pair, from the left and without overlap, replaced.

    Written out with two blanks between ids, a pair is a literal text, and replacing it goes from the left
    without overlap; so it takes one pass over ids of any number.
    """
    told = F.concat(F.lit(" "), F.array_join(ids.cast("array<string>"), "  "), F.lit(" "))
    merged = F.trim(F.replace(told, F.lit(f" {left}  {right} "), F.lit(f" {new_id} ")))
    return F.when(merged == "", F.array().cast("array<int>")).otherwise(F.split(merged, " +").cast("array<int>"))


def train_toy(df: DataFrame, merges: int, first_id: int = 256) -> list[tuple[int, int, int, int]]:
    """Merges (rank, left, right, new_id) of the one id array in df (ids): one small aggregation for each."""
    out: list[tuple[int, int, int, int]] = []
    for rank in range(merges):
        tokens = df.select(F.lit(0).alias("seq"), F.posexplode("ids").alias("pos", "token"))
        top = best_pair(tokens).first()
        if top is None:
            raise ValueError("no pair is left to merge")
        out.append((rank, top.a, top.b, first_id + rank))
        df = df.select(merge(F.col("ids"), top.a, top.b, first_id + rank).alias("ids"))
    return out


def vocabulary(merges: list[tuple[int, int, int, int]]) -> dict[int, bytes]:
    out = {k: bytes([k]) for k in range(256)}
    for _, a, b, new in merges:
        out[new] = out[a] + out[b]
    return out


def decode(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(seq, text) of token rows (seq, pos, token) by a vocabulary (id, bytes); ids it lacks are dropped."""
    found = tokens.join(vocab, tokens.token == vocab.id)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))), lambda s: s["h"]), "")
    return found.groupBy("seq").agg(F.decode(F.unhex(joined), "UTF-8").alias("text"))


def _decoder(vocab: dict[int, bytes], at_once: int):
    """Batches (ids, ...) to batches (_bytes, ...)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = np.frombuffer(b"".join(vocab.values()), np.uint8)
        most = max(vocab, default=-1) + 1
        sizes, starts = np.zeros(most + 1, np.int64), np.zeros(most + 1, np.int64)  # the last has no bytes
        own = np.array(list(vocab), np.int64)
        sizes[own] = [len(x) for x in vocab.values()]
        starts[own] = np.cumsum(sizes[own]) - sizes[own]
        for batch in _few_rows(batches):
            column = batch.column(0)
            offsets = column.offsets.to_numpy().astype(np.int64)
            ids = column.values.to_numpy(zero_copy_only=False)
            parts, ends = [], [0]
            for low in range(int(offsets[0]), int(offsets[-1]), at_once):
                k = ids[low : min(low + at_once, int(offsets[-1]))].astype(np.int64)
                k = np.where((k < 0) | (k > most), most, k)
                n = sizes[k]
                end = np.cumsum(n)
                parts.append(table[np.arange(end[-1]) - np.repeat(end - n - starts[k], n)].tobytes())
                inner = offsets[(offsets > low) & (offsets <= low + len(k))]
                ends += (end[inner - low - 1] + sum(map(len, parts[:-1]))).tolist()
            # Arrays that begin at the first offset, empty ones among them, are met before any id.
            ends = [0] * int((offsets[1:] == offsets[0]).sum()) + ends
            data = b"".join(parts)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            texts = pa.array([data[a:b] if v else None for a, b, v in zip(ends[:-1], ends[1:], valid, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([texts, *batch.columns[1:]], ["_bytes", *batch.schema.names[1:]])

    return run


def decode_arrays(arrays: DataFrame, vocab: dict[int, bytes], at_once: int = IDS_AT_ONCE) -> DataFrame:
    """arrays (ids, ...) with text in place of ids, by a vocabulary; ids it lacks are dropped, null arrays give null.  Arrays
    stay where they are and are decoded in stretches of at_once."""
    others = [c for c in arrays.columns if c != "ids"]
    schema = arrays.select(*others).schema
    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    found = arrays.select(F.col("ids").cast("array<int>").alias("ids"), *others).mapInArrow(_decoder(vocab, at_once), f"_bytes binary{', ' if told else ''}{told}")
    return found.select(*others, F.decode("_bytes", "UTF-8").alias("text"))


# --- the trainer and encoder ---------------------------------------------------------------------------


def learn(split: list[list[int]], weight: list[int], first: int, most: int, last: tuple[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Merges (left, right, new) over distinct weighted id lists, new ids from first on: at most so many, and while the best
    pair, as (-count, pair), is not past last.  Equal counts go to the smaller pair.  The lists are left merged."""
    counts: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for n, ids in enumerate(split):
        for pair in zip(ids, ids[1:], strict=False):
            counts[pair] += weight[n]
            where[pair].add(n)
    queue = [(-c, pair) for pair, c in counts.items()]
    heapq.heapify(queue)
    merges: list[tuple[int, int, int]] = []
    while queue and len(merges) < most:
        c, pair = heapq.heappop(queue)
        if -c != counts.get(pair, 0):
            if counts.get(pair, 0) > 0:
                heapq.heappush(queue, (-counts[pair], pair))
            continue
        if (c, pair) > last:
            break
        new = first + len(merges)
        merges.append((*pair, new))
        changed: dict[tuple[int, int], int] = defaultdict(int)
        for n in where.pop(pair):
            old = split[n]
            ids, k = [], 0
            while k < len(old):
                if k + 1 < len(old) and (old[k], old[k + 1]) == pair:
                    ids.append(new)
                    k += 2
                else:
                    ids.append(old[k])
                    k += 1
            for p in zip(old, old[1:], strict=False):
                changed[p] -= weight[n]
            for p in zip(ids, ids[1:], strict=False):
                changed[p] += weight[n]
                where[p].add(n)
            split[n] = ids
        for p, d in changed.items():
            if d:
                counts[p] += d
                if p != pair and counts[p] > 0:
                    heapq.heappush(queue, (-counts[p], p))
        counts.pop(pair, None)
    return merges


def train(words: dict[bytes, int], vocab_size: int, min_frequency: int = 2, specials: int = len(SPECIALS)) -> list[tuple[int, int, int, int]]:
    """Merges over distinct weighted words: ids are specials, then bytes, then merges; equal counts go to the smaller pair."""
    split = [[specials + b for b in w] for w in words]
    first = specials + 256
    found = learn(split, list(words.values()), first, vocab_size - first, (-min_frequency, (vocab_size, vocab_size)))
    return [(rank, *m) for rank, m in enumerate(found)]


def encode_word(word: bytes, ranks: dict[tuple[int, int], tuple[int, int]], specials: int = len(SPECIALS)) -> list[int]:
    """Ids of one piece: the earliest merge first, from the left.

    Places are linked and merges queued by rank and place, so a piece of any length takes n log n steps.
    """
    ids: list[int | None] = [specials + b for b in word]
    after = list(range(1, len(ids) + 1))
    before = list(range(-1, len(ids) - 1))
    queue = [(*ranks[p], k, p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
    heapq.heapify(queue)

    def offer(k: int) -> None:
        if k >= 0 and after[k] < len(ids) and (p := (ids[k], ids[after[k]])) in ranks:
            heapq.heappush(queue, (*ranks[p], k, p))

    while queue:
        _, new, k, pair = heapq.heappop(queue)
        if ids[k] is None or after[k] >= len(ids) or (ids[k], ids[after[k]]) != pair:
            continue
        gone = after[k]
        ids[k], ids[gone], after[k] = new, None, after[gone]
        if after[k] < len(ids):
            before[after[k]] = k
        offer(before[k])
        offer(k)
    return [x for x in ids if x is not None]


def special_pattern(specials: tuple[str, ...] = SPECIALS) -> str:
    """A pattern of the special tokens: the leftmost, and of several there the longest."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", x) for x in sorted(specials, key=len, reverse=True))


def cut(text: Column, specials: tuple[str, ...] = SPECIALS) -> Column:
    """Pieces of a text in order.  Special tokens are cut out first and stand whole; what lies between two of them is
    pre-tokenized by itself."""
    pattern = F.lit(special_pattern(specials))
    between, met = F.split(text, special_pattern(specials), -1), F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast("array<string>")
    parts = F.flatten(F.transform(between, lambda x, i: F.concat(pieces(x), F.when(i < F.size(met), F.array(F.get(met, i))).otherwise(none))))
    return F.when(text.rlike(special_pattern(specials)), parts).otherwise(pieces(text))


#: Bytes up to which a piece is merged together with others; longer ones are merged by themselves.
LONGEST_TOGETHER = 64


class Merges:
    """Merges (rank, left, right, new) as sorted arrays, for many pieces at once."""

    def __init__(self, merges: list[tuple[int, int, int, int]], base: int):
        import numpy as np

        told = np.array(sorted((a << 32 | b, rank, new) for rank, a, b, new in merges), np.int64).reshape(-1, 3)
        self.pairs, self.ranks, self.new = told.T
        self.by_pair = {(a, b): (rank, new) for rank, a, b, new in merges}
        self.base = base

    def together(self, data, sizes):
        """Ids of pieces that follow each other in data, and how many each has.  In a round every piece replaces its
        earliest pair, from the left and without overlap; pieces without a pair leave."""
        import numpy as np

        none = np.iinfo(np.int64).max
        ids, piece = data.astype(np.int64) + self.base, np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple] = []
        while len(self.pairs) and len(ids):
            inner = np.flatnonzero(piece[:-1] == piece[1:])
            keys = ids[inner] << 32 | ids[inner + 1]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            hit = self.pairs[at] == keys
            rank, new = np.full(len(ids), none), np.zeros(len(ids), np.int64)
            rank[inner[hit]], new[inner[hit]] = self.ranks[at[hit]], self.new[at[hit]]
            first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            over = least == none
            done.append((piece[over], ids[over]))
            at = np.flatnonzero(~over & (rank == least))
            # Places in a row are one pair of equal ids that overlaps itself: every second counts.
            begin = np.maximum.accumulate(np.where(np.append(True, np.diff(at) > 1), np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            ids[at] = new[at]
            kept = ~over
            kept[at + 1] = False
            ids, piece = ids[kept], piece[kept]
        done.append((piece, ids))
        piece, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(piece, kind="stable")], np.bincount(piece, minlength=len(sizes))

    def encode(self, words):
        """Ids of the pieces of a binary Arrow array, one after another, and how many each has."""
        import numpy as np

        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        length = np.diff(offsets)
        long = length > LONGEST_TOGETHER
        ids, own = self.together(data[np.repeat(~long, length)], length[~long])
        sizes = np.zeros(len(words), np.int64)
        sizes[~long] = own
        if not long.any():
            return ids, sizes
        others = {int(k): encode_word(words[int(k)].as_py(), self.by_pair, self.base) for k in np.flatnonzero(long)}
        sizes[long] = [len(x) for x in others.values()]
        out = np.zeros(int(sizes.sum()), np.int64)
        out[np.repeat(~long, sizes)] = ids
        ends = np.cumsum(sizes)
        for k, x in others.items():
            out[ends[k] - len(x) : ends[k]] = x
        return out, sizes


def _encoder(merges: list[tuple[int, int, int, int]], specials: tuple[str, ...], carried: tuple[str, ...]):
    """Batches (pos, pieces, carried) to batches (pos, ids, carried)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known, whole = Merges(merges, len(specials)), pa.array(specials, pa.string())
        for batch in _few_rows(batches):
            column = batch.column(1)
            coded = column.flatten().dictionary_encode()
            words = coded.dictionary
            flat, sizes = known.encode(words.cast(pa.binary()))
            special = pc.index_in(words, whole)
            if special.null_count < len(words):  # a special token is one id, whatever its bytes
                found, is_one = special.fill_null(0).to_numpy(), special.is_valid().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                kept = np.ones(len(flat), bool)
                for k in np.flatnonzero(is_one):
                    flat[ends[k] - sizes[k]] = found[k]
                    kept[ends[k] - sizes[k] + 1 : ends[k]] = False
                flat = flat[kept]
                sizes[is_one] = 1
            flat = flat.astype(np.int32)
            starts = np.cumsum(sizes) - sizes
            at = coded.indices.to_numpy(zero_copy_only=False)
            n = sizes[at]
            ends = np.cumsum(n)
            places = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(starts[at], n)
            borders = column.offsets.to_numpy() - (column.offsets[0].as_py() if len(column) else 0)
            offsets = np.concatenate([[0], ends])[borders]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[places], pa.int32())), *batch.columns[2:]], ["pos", "ids", *carried])

    return run


def encode(docs: DataFrame, merges: list[tuple[int, int, int, int]], specials: tuple[str, ...] = SPECIALS, carried: tuple[str, ...] = ()) -> DataFrame:
    """(pos, ids) of docs (pos, text), special tokens in texts as their ids; null texts have none.  Carried columns come along.

    Texts stay where they are: each Arrow batch is encoded by itself, its distinct pieces once and all together.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("pos", *carried)}
    told = ", ".join([f"pos {kinds['pos']}", "ids array<int>", *(f"`{c}` {kinds[c]}" for c in carried)])
    return docs.select("pos", cut(F.coalesce("text", F.lit("")), specials).alias("p"), *carried).mapInArrow(_encoder(merges, specials, carried), told)


def there_and_back(docs: DataFrame, merges: list[tuple[int, int, int, int]], vocab: dict[int, bytes], specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """(text, again) of docs (pos, text): texts, and what decoding their ids gives.  One Python task does both, batch by batch."""
    forth, back = _encoder(merges, specials, ("text",)), _decoder(vocab, IDS_AT_ONCE)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coded = (pa.RecordBatch.from_arrays([b.column(1), b.column(2)], ["ids", "text"]) for b in forth(batches))
        for b in back(coded):
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0)], ["text", "again"])

    pieces_ = docs.select("pos", cut(F.coalesce("text", F.lit("")), specials).alias("p"), "text")
    return pieces_.mapInArrow(run, "text string, again binary").select("text", F.decode("again", "UTF-8").alias("again"))


# --- the tokenizer as a file ---------------------------------------------------------------------------

#: Ids that two bytes hold.
MOST_IDS = 1 << 16


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level files: its own where it prints, else the next from 256 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printing else next(spare)) for b in range(256)]


def to_json(merges: list[tuple[int, int, int, int]], specials: tuple[str, ...] = SPECIALS) -> str:
    """The tokenizer in the JSON format of the tokenizers library: digits one by one, then byte-level pieces and merges."""
    if len(specials) + 256 + len(merges) > MOST_IDS:
        raise ValueError("more ids than two bytes hold")
    base = len(specials)
    names = {k: x for k, x in enumerate(specials)} | {base + b: c for b, c in enumerate(_byte_characters())}
    pairs = []
    for _, a, b, new in merges:
        pairs.append([names[a], names[b]])
        names[new] = names[a] + names[b]
    flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    told = {
        "version": "1.0",
        "truncation": None,
        "padding": None,
        "added_tokens": [{"id": k, "content": x} | flags for k, x in enumerate(specials)],
        "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, level]},
        "post_processor": None,
        "decoder": level,
        "model": {"type": "BPE", "vocab": {x: k for k, x in names.items()}, "merges": pairs},
    }
    return json.dumps(told, ensure_ascii=False, indent=1)


def from_json(told: str, specials: tuple[str, ...] = SPECIALS) -> list[tuple[int, int, int, int]]:
    """The merges of a byte-level tokenizer file.  Its special tokens must be these, first and in this order; its end-of-text
    id is then 0."""
    found = json.loads(told)
    vocab, base = found["model"]["vocab"], len(specials)
    own = {x["content"]: x["id"] for x in found.get("added_tokens", [])}
    if any(own.get(x) != k for k, x in enumerate(specials)):
        raise ValueError(f"the file's first special tokens are not {', '.join(specials)}")
    if any(vocab.get(c) != base + b for b, c in enumerate(_byte_characters())):
        raise ValueError("the file's bytes do not follow its special tokens")
    if len(vocab) > MOST_IDS:
        raise ValueError("more ids than two bytes hold")
    pairs = [x.split(" ") if isinstance(x, str) else x for x in found["model"]["merges"]]
    return [(rank, vocab[a], vocab[b], vocab[a + b]) for rank, (a, b) in enumerate(pairs)]


def special_ids(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SPECIALS)), "id int, token string")
