"""Training-data operators on small tables: brute force, round trips, held-out accuracy, and odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF, SMALL
from tidewell.llm import ctw, decontaminate, langid, license_scan, nbsvm, packing, pii, quality_rules, queries, simhash, sstable
from tidewell.llm.encoding import Encoder, vocabulary_path
from tidewell.llm.graph import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 30_000
#: Nulls, blanks, ties, repeated rows, a very long text; columns whose names operators might use themselves.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One two three four. " * 10), (4, "One two three four. " * 10), (5, "One two three four. " * 10), (None, "no id here"), (6, LONG), (7, "é" * 5000), (8, "a b c"), (9, "mail x@y.zz now")]
CLASHES = ("score", "fp", "kept", "n", "key", "chunk", "h", "t", "length", "label", "_h", "value", "number", "train")
OPERATORS = {
    "simhash": simhash.digest,
    "quality": quality_rules.quality,
    "quality_clean": quality_rules.clean,
    "simhash_keep": simhash.keep_first,
    "pii": pii.digest,
    "pii_redacted": pii.redacted,
    "license": license_scan.scan,
    "langid": langid.digest,
    "ctw": ctw.score,
    "sstable": lambda d: sstable.digest(d, vocabulary_path()),
    "packing": lambda d: packing.digest(d, vocabulary_path()),
}
#: Operators with a row for each row of documents.
ROW_FOR_ROW = {"simhash", "quality", "pii", "pii_redacted", "langid", "ctw", "sstable"}


def odd(spark, rows=ODD):
    df = spark.createDataFrame([(i, t, "en" if t else None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


def words(t):
    return SPACE.findall(t or "")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_extra_columns(spark, name):
    got = OPERATORS[name](odd(spark))
    assert (got.count() == len(ODD)) or name not in ROW_FOR_ROW
    assert OPERATORS[name](odd(spark, [])).count() == 0


def test_odd_rows_with_other_tables(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, None, 0), (99, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert nbsvm.digest(odd(spark), labels).count() == len(ODD)
    assert nbsvm.digest(odd(spark, []), labels.filter("doc_id > 1000")).count() == 0
    items = spark.createDataFrame([(1, "One two three four. One two three four. One two three"), (2, None), (3, ""), (4, "tiny")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.digest(odd(spark), items).collect()} == {4, 5}
    assert decontaminate.digest(odd(spark, []), items).count() == 0
    assert decontaminate.digest(odd(spark), items.filter("item_id > 9")).count() == 0
    kept = decontaminate.drop_contaminated(odd(spark), items)
    assert kept.count() == len(ODD) - 3 and kept.columns == odd(spark).columns


# --- 1 ---


def brute_fingerprint(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    own = {i: i for i in ids}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                own[b] = a
    return {i: root(i) for i in ids}


def test_simhash_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = brute_components(fps)
    got = queries.QUERIES["op1_simhash_pivots"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


@pytest.mark.parametrize("spread", [30, 64])
def test_links_lose_none_in_hot_cells(spark, spread):
    rng, found = random.Random(spread), set()
    for _ in range(2):
        base = rng.getrandbits(64)
        for _ in range(500):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(spread)
            found.add(x)
    u = sorted(found)
    want = {(a, b) for n, a in enumerate(u) for b in u[n + 1 :] if (a ^ b).bit_count() <= 2}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in u]
    got = [tuple(sorted((a % (1 << 64), b % (1 << 64)))) for a, b in simhash.links(spark.createDataFrame(signed, "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(3, 3)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(200, 260)]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 2, 3 ---


def test_quality_classifier_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.QUERIES["op2_nb_svm_quality"](spark, SF)
    assert got.count() == 1000
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.93


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 8)) + (20 if n % 2 else 0) for n in range(60)]
    y = np.array([n % 2 for n in range(60)])
    r = np.ones(nbsvm.FEATURES, np.float32)
    w, bias = nbsvm.dual_descent(rows, y, r)
    value = lambda w, b: 0.5 * (w @ w + b * b) + nbsvm.COST * sum(max(0, 1 - (1 if k else -1) * (w[s].sum() / math.sqrt(len(s)) + b)) for s, k in zip(rows, y, strict=True))
    best = value(w, bias)
    for _ in range(200):
        step = np.zeros_like(w)
        step[:70] = rng.normal(0, 0.02, 70)
        assert value(w + step, bias + rng.normal(0, 0.02)) > best - 0.02


def test_language_on_held_out_rows(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.QUERIES["op3_centroid_language"](spark, SF).join(truth, "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_texts_without_letters_are_und(spark):
    rows = [(1, "the cat sat", "en"), (2, "der hund lief", "de"), (3, "12 34 !!", "en"), (4, None, "en"), (5, "", "de"), (6, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.digest(df).collect()}
    assert [got[k].lang_pred == "und" for k in range(1, 7)] == [False, False, True, True, True, False]


# --- 4, 5 ---


def test_overlaps_with_and_without_substitutions(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(40)]
    docs, want = [], set()
    for k, text in items:
        w = text.split()
        for n, every in enumerate((0, 6, 5, 4)):
            v = [word() if every and j % every == every - 1 else x for j, x in enumerate(w)]
            docs.append((10 * k + n, f"{word()} {word()} " * 20 + ", ".join(v).title() + f". {word()}"))
            want.add((10 * k + n, k))
        docs.append((10 * k + 9, " ".join(word() for _ in range(60)) + " " + " ".join(w[:7])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.digest(d, b).collect()} == want


def test_query_finds_the_items_copied_into_documents(spark):
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, k) for i, t in docs.items() for k, p in items.items() if p in t}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_spaced_seeds"](spark, SF).collect()}
    assert want and want <= got


def test_known_sentences_hold_a_cue_and_rules_name_them():
    known = license_scan.sentences()
    assert all(any(c in s for c in license_scan.CUES) for s in known.values())
    assert {x for _, ids in license_scan.rules() for x in ids} <= set(known)


def test_licences(spark):
    s = license_scan.SENTENCES
    mit = f"{s['mit_grant'].capitalize()}:\n\n{s['mit_notice']}.\n\n{s['mit_warranty']}."
    wrapped = "\n".join(re.findall(r".{1,60}(?: |$)", s["mit_grant"]))
    rows = [(1, mit), (2, "Intro.\nReleased under the MIT License.\nMore"), (3, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."), (4, "no license here"), (5, wrapped), (6, "This work is licensed under the GNU General Public License, version 3."), (7, None), (8, s["mit_notice"])]
    got = {r.doc_id: (r.licenses, r.n_rules) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1), 2: ("MIT", 1), 3: ("Apache-2.0,CC-BY-NC-4.0", 2), 5: ("MIT", 1), 6: ("GPL-3.0", 1)}


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GNU = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU {1} Public License as published by
the Free Software Foundation{2} either version {3} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful."""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "; "])
def test_real_notices_plain_and_in_comments(spark, mark):
    texts = {
        "Apache-2.0": APACHE,
        "MPL-2.0": MPL,
        "GPL-3.0-or-later": GNU.format(":", "General", ",", "3"),
        "GPL-2.0-or-later": GNU.format(";", "General", ";", "2"),
        "LGPL-2.1-or-later": GNU.format(";", "Lesser General", ";", "2.1"),
        "AGPL-3.0-or-later": GNU.format(":", "Affero General", ",", "3"),
    }
    rows = [(k, "\n".join((mark + x).rstrip() for x in ["Copyright 2020 A. B.", "", *t.split("\n")])) for k, t in enumerate(texts.values())]
    rows = [(k, f"/*\n{t}\n */" if "*" in mark else t) for k, t in rows]
    got = {r.doc_id: r.licenses for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(texts))


def test_licence_query_finds_every_plain_line(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id for r in docs.filter(F.col("text").rlike("(?i)(licensed|released) under (the|cc)\\W")).collect()}
    assert {r.doc_id for r in queries.QUERIES["op5_license_sentences"](spark, SF).collect()} == want


# --- 6, 10 ---


def brute_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return [np.array(e.ids, "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_the_library():
    texts = ["Don't it's", "<|endoftext|> a<|startoftext|>b", "A B c\x1cd", "é ẛ̣", "x" * 500, "12 3a4", "foo.'s ,.;", "İx ßÿ", "", None, "a_b -- 中文"]
    e = Encoder(vocabulary_path())
    for _ in range(2):
        got = e.encode([None if t is None else t.encode() for t in texts])
        assert got == [x.tobytes() for x in brute_ids(texts)]


def test_shards_give_every_document_back(spark):
    docs = odd(spark).unionByName(odd(spark, [(k, f"text {k} " * (k % 7)) for k in range(100, 400)] + [(-5, "negative")]))
    path = f"{sstable.fresh_path(spark, 'test')}"
    manifest = sstable.write_shards(docs, path, vocabulary_path(), 1, 4)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.collect())
    want, at = [], 0
    for (known, i), ids in zip([r[0] for r in rows], brute_ids([t for _, t in rows]), strict=True):
        ids = np.append(ids, 1).astype("<u4")
        want.append((i if known else None, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in sstable.read_shards(manifest).orderBy("start").collect()]
    assert got == want
    assert sstable.lookup(manifest, 250).tolist() == [*brute_ids(["text 250 " * (250 % 7)])[0].tolist(), 1]
    assert sstable.lookup(manifest, -5) is not None and sstable.lookup(manifest, 12345) is None


def test_one_shard_of_many_blocks(tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(k), rng.integers(0, 70_000 if k % 3 else 1000, int(rng.integers(0, 4000))).astype("<u4")) for k in np.unique(rng.integers(-(1 << 40), 1 << 40, 700))]
    with open(tmp_path / "s", "wb") as out:
        w = sstable.ShardWriter(out)
        for k, ids in rows:
            w.add(sstable.key_of(k), ids)
        w.close()
    with open(tmp_path / "s", "rb") as f:
        r = sstable.ShardReader(f)
        assert len(r.blocks) > 3 and r.docs == len(rows)
        assert all(a == sstable.key_of(k) and (b == ids).all() for (a, b), (k, ids) in zip(r.scan(), rows, strict=True))
        assert all((r.get(k) == ids).all() for k, ids in rows[::13])
        missing = [k + 1 for k, _ in rows if k + 1 not in dict(rows)]
        assert all(r.get(k) is None for k in missing[::11]) and sum(map(r.may_hold, map(sstable.key_of, missing))) < 0.05 * len(missing)


def best_possible(lengths, capacity):
    """The fewest sequences, by trying."""
    lengths = sorted(lengths, reverse=True)

    def fits(k, rooms):
        if k == len(lengths):
            return True
        seen = set()
        for n, room in enumerate(rooms):
            if room >= lengths[k] and room not in seen:
                seen.add(room)
                rooms[n] -= lengths[k]
                if fits(k + 1, rooms):
                    return True
                rooms[n] += lengths[k]
        return False

    n = max(1, -(-sum(lengths) // capacity))
    while not fits(0, [capacity] * n):
        n += 1
    return n


def test_reduction_never_costs_a_sequence():
    rng = random.Random(10)
    for _ in range(300):
        capacity = rng.choice([20, 30, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        fixed, rest = packing.reduce_dominated(Counter(lengths), capacity)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (best_possible(left, capacity) if left else 0) == best_possible(lengths, capacity)


def test_plans_hold_every_piece_once():
    rng = random.Random(11)
    for _ in range(50):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 2000)))
        got = Counter()
        for pattern, n in packing.plan(counts, 100):
            assert sum(pattern) <= 100 and n > 0
            for x in pattern:
                got[x] += n
        assert got == counts


def test_packing_query(spark):
    rows = queries.QUERIES["op10_dominance_packing"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {}
    for r, ids in zip(docs, brute_ids([r.text for r in docs]), strict=True):
        ids = np.append(ids, 0).astype("<u4")
        want |= {(r.doc_id, k // 2048): (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048 and len(by) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


# --- 7 ---


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda x: re.sub("[^0-9]", "", x)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1290.@+-() \n%") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_long_runs_take_no_square_time():
    assert pii.base_spans("1" * 100_000 + "a" * 100_000 + "@" * 1000) == []


def test_pii_query(spark):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op7_semi_markov_pii"](spark, SMALL).collect():
        base = brute_spans(docs[r.doc_id])
        told = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(told) <= set(r.spans.split(",")) | ({""} if not told else set())


def test_field_adds_what_the_patterns_miss():
    field = pii.fit([])
    added = lambda t: pii.all_spans(t, pii.base_spans(t), field)
    assert added("call me at (555) 123-4567 ok") == [("phone", 11, 25)]
    for t in ("on 2020-01-02 at 12:30", "bob@localhost", "costs 12.50 in 2019", "plain words"):
        assert added(t) == []
    assert pii.redact("a x@y.zz b 10.0.0.1", [("email", 2, 8), ("ip", 11, 19)]) == "a [EMAIL] b [IP]"


def test_field_sums_over_all_segmentations():
    """The forward sum equals the sum over segmentations listed one by one."""
    field = pii.fit([])
    text = "at 10.0 b"
    cut = pii.atoms(text, 0, len(text))
    lat = pii.lattice(text, cut)
    score, out = field.scores(lat), [field.outside.get(pii.atom_feature(text, *c), 0.0) for c in cut]

    def total(at, last):
        if at == lat.n:
            return [0.0]
        found = [field.pair[last, pii.OTHER] + out[at] + x for x in total(at + 1, pii.OTHER)]
        for k, (i, j) in enumerate(lat.spans):
            if i == at:
                for y in range(len(pii.KINDS)):
                    found += [field.pair[last, y] + score[k, y] + x for x in total(j, y)]
        return found

    a, _ = field._forward(lat, score, out, False)
    assert np.logaddexp.reduce(a[lat.n]) == pytest.approx(np.logaddexp.reduce(total(0, pii.OTHER)))
    best, _ = field._forward(lat, score, out, True)
    assert best[lat.n].max() == pytest.approx(max(total(0, pii.OTHER)))


# --- 8 ---


def brute_quality(t):
    t = t or ""
    w = words(t)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    times = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op8_line_quality"](spark, SF).collect():
        want = brute_quality(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_quality_of_odd_rows(spark):
    rows = ODD + [(20, ("a b c d e f g h i " * 3) + "x\n\nx\nx y"), (21, "w " * 9), (22, "\n".join(["one two three four five six seven eight nine"] * 2))]
    for r, (_, t) in zip(quality_rules.quality(odd(spark, rows).coalesce(1)).collect(), rows, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t)


def test_lines_that_fail_go(spark):
    good = [f"A plain sentence of quite ordinary {x} follows here." for x in ("words", "prose", "things")]
    text = "\n".join([good[0], "Home | News | Shop | About", "BUY NOW AND SAVE MONEY", "All rights reserved.", "### $$$ %%%", *good[1:]])
    df = spark.createDataFrame([(1, text, len(text)), (2, "\n".join(f"w{k}### x{k}*** y$$$ z" for k in range(20)), 9)], "doc_id long, text string, n_chars long")
    rows = quality_rules.clean(df, most_lost=60).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in rows] == [(1, "\n".join(good), len("\n".join(good)))]


def test_clean_documents_are_kept(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.QUERIES["op8_line_quality"](spark, SF).join(labels, "doc_id").filter("quality = 1 AND NOT base_failed")
    assert rows.filter("NOT kept").count() == 0


def test_scripts_without_case_are_not_shouted(spark):
    lines = ["هذا نص عربي نظيف من عدة كلمات كتبه NATO", "यह एक साफ हिंदी पाठ है जिसमें शब्द हैं", "이것은 여러 단어로 된 깨끗한 글 입니다"]
    rows = [(k, "\n".join(" ".join(f"{w}{n}" for w in x.split()) for n in range(4))) for k, x in enumerate(lines)] + [(9, "THIS LINE IS ALL IN CAPITALS\n" + "plain words " * 3)]
    got = {r.doc_id: (r.lost_chars, r.kept) for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 9: (28, False)}


def test_long_lines_with_a_boilerplate_word_stay(spark):
    prose = " ".join(f"the baker sold word{n} and then went home" for n in range(8))
    lines = [f"{prose} with a cookie.", f"{prose} a > b and b > c and c > d.", "Many a blog in those years was plain and quiet."]
    bad = ["We use cookies.", "Home | News | Shop | About", "Log in here", " | ".join(f"item{n}" for n in range(40)), "Read more, click here, subscribe to our newsletter, all rights reserved. " * 4]
    got = {r.l: r.fails for r in spark.createDataFrame([(x,) for x in lines + bad], "l string").select("l", quality_rules.line_fails(F.col("l")).alias("fails")).collect()}
    assert got == dict.fromkeys(lines, False) | dict.fromkeys(bad, True)
    assert quality_rules.quality(spark.createDataFrame([(1, lines[0])], "doc_id long, text string")).first().kept


# --- 9 ---


class BruteTree:
    def __init__(self, texts, depth):
        self.depth, self.nodes = depth, [{} for _ in range(depth + 1)]
        for w in texts:
            for context, byte in self.symbols(w):
                for k in range(8):
                    for d in range(depth + 1):
                        self.nodes[d].setdefault((context[depth - d :], 1 << k | byte >> (8 - k)), [0, 0])[byte >> (7 - k) & 1] += 1
        kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        self.weight, below = [{} for _ in range(depth + 1)], {}
        for d in range(depth, -1, -1):
            up = {}
            for (context, z), counts in self.nodes[d].items():
                own, rest = kt(*counts), below.get((context, z), 0.0)
                self.weight[d][context, z] = 1 / (1 + math.exp(min(700, rest - own)))
                value = own if d == depth else np.logaddexp(own, rest) - math.log(2)
                up[context[1:], z] = up.get((context[1:], z), 0.0) + value
            below = up

    def symbols(self, w):
        f = b"\xff" * self.depth + b" ".join(w) + b"\xff"
        return [(f[j - self.depth : j], f[j]) for j in range(self.depth, len(f))]

    def score(self, w):
        total = 0.0
        for context, byte in self.symbols(w):
            for k in range(8):
                z, bit, p = 1 << k | byte >> (8 - k), byte >> (7 - k) & 1, 0.5
                for d in range(self.depth, -1, -1):
                    counts = self.nodes[d].get((context[self.depth - d :], z))
                    own = (counts[bit] + 0.5) / (sum(counts) + 1) if counts else 0.5
                    w_d = 1.0 if d == self.depth else self.weight[d].get((context[self.depth - d :], z), 0.5)
                    p = w_d * own + (1 - w_d) * p
                total += math.log10(p)
        return total


def test_context_tree_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    low = lambda t: (t or "").encode().lower().split()
    train = [low(t) for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(x for w in train for x in w)
    counts[b""] = len(train)
    n, v = sum(counts.values()), len(counts)
    tree = BruteTree(train, ctw.DEPTH)
    got = {r.doc_id: r for r in queries.QUERIES["op9_context_tree"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        w, r = [*low(t), b""], got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    for i, t in docs[::9]:
        assert got[i].score == pytest.approx(tree.score(low(t)), rel=1e-6)


def test_probabilities_of_a_byte_sum_to_one(spark):
    texts = [b"abab", b"abba", b"ccc"]
    keys, _ = ctw.context_keys(texts, 5)
    k, n = np.unique(keys, return_counts=True)
    context = int(k[3]) >> 8 << 8
    every = np.arange(context, context + 256)
    both = np.unique(np.concatenate([k, every]))
    counts = np.zeros(len(both), np.int64)
    counts[np.searchsorted(both, k)] = n
    p, up = ctw.mix_below(both, counts, 5)
    node, inverse = np.unique(up["node"], return_inverse=True)
    top = ctw.Top(node, *(np.bincount(inverse, up[c]) for c in ("zeros", "ones", "weighted")))
    chosen = np.searchsorted(both, every)
    assert (10 ** top.log10(every, p[chosen], 5)).sum() == pytest.approx(1)
