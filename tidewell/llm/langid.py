"""Language identification by nearest centroids.

Byte n-grams (one to four bytes, of lower-cased text with other than letters as one blank) are hashed into
FEATURES slots.  A text's vector is its TF-IDF, normalised; every learned language has up to CENTROIDS
centroids, found by spherical k-means on its training vectors; the language of the centroid with the largest
cosine is the prediction.  A text farther from it than nearly all training texts of that language is marked
as rejected.

The fit uses at most SAMPLE documents a language, those of the smallest id hashes, from the training folds; their
vectors are made and clustered by the executors.  Every document is predicted.

Defined results: texts that are null or have no letter are `und` with score 0 and rejected; a null lang is
never learned from; without any training row every text is `und`; ties go to the language that sorts first;
each row is judged by itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_hash_mod, written

FEATURE_BITS = 13
FEATURES = 1 << FEATURE_BITS
LONGEST = 4
CENTROIDS = 4
SAMPLE = 800
ROUNDS = 8
#: Share of a language's training texts that its distance bound rejects.
REJECTED = 0.005
UNKNOWN = "und"
#: Bytes that are counted at once.
TOGETHER = 1 << 21

_MAP = np.full(256, 32, np.uint8)
_MAP[128:] = np.arange(128, 256)
_MAP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MAP[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MULTIPLIERS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]


def counts(texts: list[bytes]) -> np.ndarray:
    """(texts, FEATURES) counts of hashed n-grams, blank to blank; a text of any length is counted in pieces."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    group: list[int] = []
    size = 0
    for n, text in enumerate(texts):
        if len(text) > TOGETHER:
            out[n] = _counted_long(text)
            continue
        if size + len(text) > TOGETHER:
            out[group] = _counted([texts[k] for k in group])
            group, size = [], 0
        group.append(n)
        size += len(text)
    if group:
        out[group] = _counted([texts[k] for k in group])
    return out


def _counted(texts: list[bytes]) -> np.ndarray:
    lengths = np.array([len(t) + 2 for t in texts])
    raw = _MAP[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)]
    row = np.repeat(np.arange(len(texts), dtype=np.int64) << FEATURE_BITS, lengths)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32) | (row[1:] != row[:-1])
    raw, row = raw[keep], row[keep]
    out = np.zeros(len(texts) << FEATURE_BITS, np.int64)
    gram = np.zeros(len(raw), np.uint32)
    whole = raw.astype(np.uint32)
    shift = np.uint32(32 - FEATURE_BITS)
    for n in range(1, LONGEST + 1):
        gram = (gram[: len(raw) - n + 1] << np.uint32(8)) | whole[n - 1 :]
        at = row[: len(gram)]
        inside = at == row[n - 1 :]
        slot = ((gram ^ (gram >> np.uint32(15))) * _MULTIPLIERS[n - 1]) >> shift
        out += np.bincount((at + slot)[inside], minlength=len(out))
    return out.reshape(len(texts), FEATURES)


def _counted_long(text: bytes) -> np.ndarray:
    """The counts of _counted, of one text, whose n-grams are made in stretches that overlap and counted where they begin."""
    raw = np.concatenate([[32], _MAP[np.frombuffer(text, np.uint8)], [32]]).astype(np.uint8)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw = raw[keep]
    out = np.zeros(FEATURES, np.int64)
    shift = np.uint32(32 - FEATURE_BITS)
    for at in range(0, len(raw), TOGETHER):
        for n in range(1, LONGEST + 1):
            whole = raw[at : at + TOGETHER + n - 1].astype(np.uint32)
            gram = np.zeros(max(0, len(whole) - n + 1), np.uint32)
            for k in range(n):
                gram = (gram << np.uint32(8)) | whole[k : k + len(gram)]
            out += np.bincount(((gram ^ (gram >> np.uint32(15))) * _MULTIPLIERS[n - 1]) >> shift, minlength=FEATURES)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (all centroids, FEATURES), unit length
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # of each language: cosines below are rejected

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, their largest cosines, and whether rejected."""
        v = counts(texts)
        np.log1p(v, out=v)
        v *= self.idf
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        cosine = v @ self.centroids.T
        best = np.stack([cosine[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        found = best.argmax(axis=1)
        top = best[np.arange(len(texts)), found]
        return found, np.clip(top, 0, 1), top < self.least[found]


def _clusters(v: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means; the first centres are far apart."""
    rng = np.random.default_rng(seed)
    centres = [v[rng.integers(len(v))]]
    while len(centres) < min(k, len(v)):
        near = np.max(v @ np.array(centres).T, axis=1)
        centres.append(v[int(near.argmin())])
    c = np.array(centres)
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(axis=1)
        c = _unit(np.array([v[own == n].mean(axis=0) if (own == n).any() else c[n] for n in range(len(c))]))
    return c


def held_out(doc_id: Column) -> Column:
    return id_hash_mod(doc_id, 4) == 2


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, k, text) of at most sample documents a language that are not held out and not blank; k orders them."""
    told = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL").filter(F.col("text").rlike(r"\S")).filter(~held_out(F.col("doc_id")))
    # A bound on the hash, with room to spare, leaves few rows of each language to be moved and ranked.  The sizes
    # are one number for each language that the model will hold, of different rows, so that rows of one id or text count once.
    drawn = told.select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id", "text", F.lit(13)), F.lit(1_000_000_000)).alias("_h"))
    sizes = {r.lang: r.n for r in drawn.select("lang", "_h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    bound = F.lit(0.0)
    for lang, n in sizes.items():
        bound = F.when(F.col("lang") == lang, 1e9 * (2 * sample + 200) / n).otherwise(bound)
    near = drawn.filter(F.col("_h") < bound).dropDuplicates(["lang", "_h", "doc_id", "text"])
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "text")))
    return ranked.filter(F.col("k") <= sample).select("lang", "k", "text")


def vectors(rows: DataFrame) -> DataFrame:
    """(lang, k, slots, counts) of rows (lang, k, text): the slots that are not empty and ln(1 + count) in each, packed."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.log1p(counts(part.column(2).cast(pa.large_binary()).to_pylist()))
                slots = [np.flatnonzero(x) for x in found]
                packed = [[x.astype("<u2").tobytes() for x in slots], [v[x].astype("<f4").tobytes() for v, x in zip(found, slots, strict=True)]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.binary()) for x in packed)], ["lang", "k", "slots", "counts"])

    return rows.select("lang", "k", "text").mapInArrow(run, "lang string, k int, slots binary, counts binary")


def _document_counts(found: DataFrame) -> tuple[int, np.ndarray]:
    """The number of vectors, and of those that have each slot: one row a batch is summed here."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for slots in batch.column(0).to_pylist():
                seen[np.frombuffer(slots, "<u2")] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([seen.tobytes()])], ["n", "seen"])

    n, seen = 0, np.zeros(FEATURES, np.int64)
    for r in found.select("slots").mapInArrow(run, "n long, seen binary").toLocalIterator():
        n, seen = n + r.n, seen + np.frombuffer(r.seen, np.int64)
    return n, seen


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model.  Each language is fitted by a task of its own on at most sample vectors; the driver holds centroids alone."""
    found = written(vectors(training_rows(docs, sample)), "language-vectors")
    n, seen = _document_counts(found)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 0.1

    def cluster(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        v = np.zeros((len(rows), FEATURES), np.float32)
        for own, slots, values in zip(v, rows["slots"], rows["counts"], strict=True):
            own[np.frombuffer(slots, "<u2")] = np.frombuffer(values, "<f4")
        v = _unit(v * idf)
        # Long texts come nearer to any centroid than short ones, so the clusters are found on all lengths.
        c = _clusters(v, CENTROIDS, 0)
        return pd.DataFrame({"lang": [key[0]], "least": [float(np.quantile((v @ c.T).max(axis=1), REJECTED))], "centroids": [c.astype("<f4").tobytes()]})

    rows = sorted(found.groupBy("lang").applyInPandas(cluster, "lang string, least double, centroids binary").collect())
    centroids = [np.frombuffer(r.centroids, "<f4").reshape(-1, FEATURES) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in centroids])
    return Model([r.lang for r in rows], idf, np.concatenate(centroids), owner, np.array([r.least for r in rows]))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by CENTROIDS and FEATURES for each language

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own: Model | None = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                rows = [(UNKNOWN, 0.0, True)] * len(texts)
                if own and (known := [n for n, t in enumerate(texts) if t is not None]):
                    for n, k, s, r in zip(known, *own.predict([texts[n] for n in known]), strict=True):
                        rows[n] = own.languages[k], float(s), bool(r)
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in columns)], ["doc_id", "lang_pred", "score", "rejected"])

    letters = F.col("text").rlike(r"\p{L}")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(letters, F.col("text")).alias("text"))
    return read.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def digest(docs: DataFrame) -> DataFrame:
    found = identify(docs, fitted(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
