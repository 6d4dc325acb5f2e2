"""Rows and tables that are hard for an operator: other scripts' digits, repetitions, very long texts, odd tables."""

from __future__ import annotations

import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_operators import ODD, brute_ids, odd
from tidewell.llm import common, ctw, decontaminate, langid, license_scan, nbsvm, pii, quality_rules, queries, simhash, sstable
from tidewell.llm.encoding import vocabulary_path
from tidewell.sources import storage

DIGITS = ["see 1.2.3.² now", "10.1.2.① x", "call +१२३ ४५६ ७८९०", "card ٤١١١١١١١١١١١١١١١", "½.¼.1.2 a²@x.de"]


# --- personal data ---


def test_digits_of_other_scripts_are_no_digits(spark):
    df = spark.createDataFrame(list(enumerate(DIGITS)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.digest(df).collect()}
    assert [rows[k].spans for k in range(4)] == [""] * 4 and all(rows[k].n_ip + rows[k].n_card + rows[k].n_phone == 0 for k in rows)
    assert {r.doc_id: r.text for r in pii.redacted(df).collect()}[0] == DIGITS[0]


def hard_texts():
    rng = random.Random(12)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/") for _ in range(5_000_000))
    return [blob, "7" * 1_000_000, "1." * 20_000, "12 " * 20_000, "a@" * 20_000, "+" * 100_000, "(" * 100_000 + "1"]


def test_long_texts_without_blanks_take_linear_time():
    field = pii.fit([])
    for t in hard_texts():
        began = time.time()
        pii.all_spans(t, pii.base_spans(t), field)
        assert time.time() - began < 60


def test_decoding_finds_the_best_segmentation():
    """The sliding decoder's spans score as much as the best path of the whole lattice."""
    field = pii.fit([])
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["12", "345", "4111111111111111", "10.2.3.4", " ", "-", ".", "+", "(", ")", "ab@c.de", "@"]) for _ in range(rng.randint(1, 12)))
        for a, b in pii.sites(text):
            cut = pii.atoms(text, a, b)
            lat = pii.lattice(text, cut)
            score, out = field.scores(lat), [field.outside.get(pii.atom_feature(text, *c), 0.0) for c in cut]
            best, _ = field._forward(lat, score, out, True)
            where = {(cut[i][0], cut[j - 1][1]): k for k, (i, j) in enumerate(lat.spans)}
            starts, last, total, at = {c[0]: n for n, c in enumerate(cut)}, pii.OTHER, 0.0, 0
            found = {s[1]: s for s in field.decode(text, a, b)}
            while at < len(cut):
                s = found.get(cut[at][0])
                if s:
                    y = pii.KINDS.index(s[0])
                    total += field.pair[last, y] + score[where[s[1], s[2]], y]
                    at = starts[s[2]] if s[2] in starts else len(cut)
                else:
                    y = pii.OTHER
                    total += field.pair[last, y] + out[at]
                    at += 1
                last = y
            assert total == pytest.approx(best[lat.n].max())


def test_field_on_held_out_lines():
    field = pii.fit([])
    right = wrong = missed = 0
    for text, gold in pii.generated(1000, seed=99):
        got = {s for a, b in pii.sites(text) for s in field.decode(text, a, b)}
        right, wrong, missed = right + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


# --- licences ---


def test_words_of_a_cue_may_be_parted_by_anything(spark):
    plain = ["This work is in the public domain.", "Released under the MIT License.", "Unlicensed: permission is hereby granted"]
    parted = ["This work is in the public\ndomain.", "This work is in the public-domain.", "This work is in the public\n# domain.", "Released --  under the MIT License.", "RELEASED\tUNDER the mit licence. released under the MIT license"]
    got = {r.doc_id: r.licenses for r in license_scan.scan(spark.createDataFrame(list(enumerate(plain + parted)), "doc_id long, text string")).collect()}
    assert got == {0: "Public-Domain", 1: "MIT", 3: "Public-Domain", 4: "Public-Domain", 5: "Public-Domain", 6: "MIT", 7: "MIT"}


def test_equal_rows_give_equal_rows(spark):
    s = license_scan.SENTENCES
    mit = f"{s['mit_grant'].capitalize()}:\n\n{s['mit_notice']}.\n\n{s['mit_warranty']}."
    rows = license_scan.scan(spark.createDataFrame([(1, mit), (1, mit), (None, mit), (2, "no")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.licenses, r.n_rules, r.n_sentences) for r in rows) == [(0, "MIT", 1, 3), (1, "MIT", 1, 3), (1, "MIT", 1, 3)]


def test_two_and_three_clauses_are_told_apart(spark):
    s = license_scan.SENTENCES
    two = [s["bsd_redist"] + ":", "1. " + s["bsd_source"] + ".", "2. " + s["bsd_binary"] + "."]
    three = [*two, "3. " + s["bsd_names"] + "."]
    end = s["bsd_disclaimer"] + "."
    zlib_ = ". ".join(s[k] for k in ("zlib_as_is", "zlib_liable", "zlib_grant")) + ":"
    texts = ["\n\n".join([*two, end]), "\n\n".join([*three, end]), "\n\n".join(two), "\n\n".join(three), zlib_, s["boost_grant"] + ":", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright"]
    got = [r.licenses for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["BSD-2-Clause", "BSD-3-Clause", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "GPL-3.0"]


def test_cues_lose_no_known_sentence():
    known = license_scan.known_sentences()
    assert all(any(c in s for c in license_scan.CUES) for s in known)
    numbers = set(known.values())
    assert all(int(x[1:-1]) in numbers for _, ids in license_scan.numbered_rules() for x in ids.split())


# --- decontamination ---


def overlaps_of(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_equal, r.n_words) for r in decontaminate.digest(d, b).collect()}


def test_repeated_words_meet_once(spark):
    began = time.time()
    got = overlaps_of(spark, [(1, "w " * 4000), (2, "b a " * 1000), (3, "x " + "w " * 9)], [(1, "w " * 2000), (2, "a b " * 500)])
    assert got == {(1, 1): (2000, 2000), (2, 2): (1000, 1000)} and time.time() - began < 60


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "five words only are here"), (2, "短い日本語の文"), (3, "Unique"), (4, "five words only are here"), (5, "..."), (None, "no id")]
    docs = [(1, "Say: five words, only ARE here now"), (2, "これは短い日本語の文です"), (3, "five words only were here"), (4, "a unique thing"), (None, "unique"), (5, "")]
    assert overlaps_of(spark, docs, items) == {(1, 1): (5, 5), (1, 4): (5, 5), (2, 2): (7, 7), (4, 3): (1, 1)}


def test_recall_with_a_quarter_replaced(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 59)))) for k in range(200)]
    docs = []
    for k, text in items:
        w = text.split()
        for j in rng.sample(range(len(w)), len(w) // 4):
            w[j] = word()
        docs.append((k, " ".join(word() for _ in range(40)) + " " + " ".join(w) + " end"))
    got = overlaps_of(spark, docs, items)
    assert all(i == k for i, k in got) and len(got) >= 0.9 * len(items)


def test_equal_rows_count_once_and_no_row_is_lost(spark):
    item = " ".join(f"word{k}" for k in range(20))
    rows = decontaminate.digest(spark.createDataFrame([(1, item), (1, item), (1, "other")], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [tuple(r) for r in rows] == [(1, 7, 1, 20, 20)]


# --- classifiers by hand ---


def test_quality_scores_equal_a_plain_model(spark):
    """The query's scores by sets of grams, dictionaries and the same training order."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = nbsvm.training_rows(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"), nbsvm.held_out).orderBy("place", "doc_id").collect()
    assert sorted((r.text, r.label) for r in rows) == sorted((docs[i], q) for i, q in labels.items() if i in docs and zlib.crc32(str(i).encode()) % 5)
    hashed = lambda b: nbsvm.Features._hash(b)

    def slots(t):
        h = [int(hashed(w)) for w in t.encode().split()]
        grams = h + [a ^ (b << 1) % (1 << 64) for a, b in zip(h, h[1:], strict=False)] + [int(hashed(b"\x00" + w[-3:])) for w in t.encode().split()]
        grams += [int(hashed(b"\x00again"))] if any(a == b for a, b in zip(h, h[1:], strict=False)) else []
        return {(g * int(nbsvm._MIX) % (1 << 64)) >> (64 - nbsvm.FEATURE_BITS) for g in grams}

    model = nbsvm.fit([r.text.encode() for r in rows], [r.label for r in rows])
    seen = [slots(r.text) for r in rows]
    counts = [dict(), dict()]
    for s, r in zip(seen, rows, strict=True):
        for x in s:
            counts[r.label][x] = counts[r.label].get(x, 0) + 1
    total = [sum(c.values()) + nbsvm.SMOOTHING * nbsvm.FEATURES for c in counts]
    ratio = lambda x: math.log((counts[1].get(x, 0) + nbsvm.SMOOTHING) / total[1]) - math.log((counts[0].get(x, 0) + nbsvm.SMOOTHING) / total[0])
    made = nbsvm.log_count_ratios([np.array(sorted(s)) for s in seen], np.array([r.label for r in rows]))
    assert all(made[x] == pytest.approx(ratio(x), rel=1e-4, abs=1e-5) for x in list(seen[0])[:200])
    for r in queries.QUERIES["op2_nb_svm_quality"](spark, SMALL).collect():
        s = slots(docs[r.doc_id] or "")
        margin = sum(float(model.weights[x]) for x in s) / math.sqrt(max(1, len(s))) + model.bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.shift))), rel=1e-3)


def test_languages_equal_a_plain_nearest_centroid(spark):
    """Grams counted one by one in dictionaries, and cosines with the fitted centroids summed over them."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fitted(docs)
    assert len(model.centroids) <= langid.CENTROIDS * len(model.languages)
    got = {r.doc_id: r for r in queries.QUERIES["op3_centroid_language"](spark, SMALL).collect()}

    def grams(text):
        t = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.encode().lower() + b" ")
        out = {}
        for n in range(1, langid.LONGEST + 1):
            for k in range(len(t) - n + 1):
                g = int.from_bytes(t[k : k + n], "big")
                slot = (((g ^ (g >> 15)) * int(langid._MULTIPLIERS[n - 1])) % (1 << 32)) >> (32 - langid.FEATURE_BITS)
                out[slot] = out.get(slot, 0) + 1
        return out

    for r in docs.limit(40).collect():
        v = {k: math.log1p(n) * float(model.idf[k]) for k, n in grams(r.text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(float(c[k]) * x for k, x in v.items()) / size for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[r.doc_id].score == pytest.approx(cosines[best], abs=1e-4)
        assert got[r.doc_id].lang_pred == model.languages[model.owner[best]] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-4


# --- hot keys ---


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(90)] + [(99, 1)], "key long, x int")
    table = rows.filter("key < 50").groupBy("key").agg(F.count("*").alias("n"), F.max("x").alias("m"))
    got = common.join_hot(rows, table, "key", "n", 91)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table, "key").collect())) and got.count() == 90


def test_groups_are_the_same_with_hot_fingerprints(spark, monkeypatch):
    docs = odd(spark).unionByName(odd(spark, [(k, f"the same words again and again {k % 2}") for k in range(100, 160)]))
    want = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want


# --- shards, chunks, shared folder ---


def test_shard_query_equals_the_library(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    want, at = [], 0
    for (i, _), ids in zip(docs, brute_ids([t for _, t in docs]), strict=True):
        ids = np.append(ids, 1).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.QUERIES["op6_sorted_string_tables"](spark, SMALL).collect()) == want


def test_ranges_roll_over_into_shards(spark):
    docs = spark.createDataFrame([(k // 2, f"text {k} " * 20) for k in range(200)], "doc_id long, text string")
    manifest = sstable.write_shards(docs, sstable.fresh_path(spark, "test"), vocabulary_path(), 1, 3, shard_docs=10)
    rows = manifest.orderBy("shard", "part").collect()
    assert len(rows) > 15 and max(r.n_docs for r in rows) == 10 and all(a.last_id <= b.first_id for a, b in zip(rows, rows[1:], strict=False))
    assert sum(r.n_docs for r in rows) == 200 and len(sstable.lookup(manifest, 57)) and sstable.lookup(manifest, 500) is None
    starts = sorted((r.start, r.n_tokens) for r in sstable.read_shards(manifest).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_scores_do_not_depend_on_chunks(spark):
    docs = odd(spark).unionByName(odd(spark, [(k, f"some words {k % 5} here") for k in range(100, 200)]))
    told = lambda n: sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 6), round(r.bits_per_byte, 6)) for r in ctw.score(docs, chunk_bytes=n).collect())
    assert told(1 << 24) == told(200)


def test_paths_without_a_scheme_are_resolved_by_spark(spark, tmp_path):
    assert storage.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.defaultFS", "viewfs://other")
    conf.set("fs.viewfs.mounttable.other.link./far", f"file://{tmp_path}")
    try:
        assert storage.qualified(spark, "/far/x") == "viewfs://other/far/x"
    finally:
        conf.unset("fs.defaultFS")
    with pytest.raises(ValueError):
        storage.filesystem("/no/scheme")


# --- the pipeline on odd tables ---


def test_working_names_may_be_taken(spark):
    df = odd(spark).selectExpr("*", "1 AS _q_h", "2 AS _q_row", "'y' AS _q_win")
    assert quality_rules.clean(df).columns == df.columns


def test_pipeline_takes_odd_rows(spark, tmp_path):
    texts = [*DIGITS, *hard_texts()[1:], hard_texts()[0], " ".join(f"mail me{k}@example.org or 10.0.0.{k}" for k in range(30))]
    prose = "Plain words make this text long enough to be kept by every rule of the first stage, as there are well over twenty of them here."
    rows = ODD + [(100 + k, t) for k, t in enumerate(texts)] + [(200 + k, f"{prose} Number {k} {DIGITS[k % 5]}.") for k in range(5)] + [(200, prose), (None, prose)]
    df = odd(spark, rows).selectExpr("*", "1 AS _q_h", "2 AS item_id", "3 AS row", "4 AS piece")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {200, 201, 202, 203, 204} <= kept
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
