"""Licence notices as files have them, and samples of odd labelled rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import odd
from tidewell.llm import langid, license_scan, nbsvm

COMMENTS = ["{}", "// {}", "# {}", "/* {} */", "<!-- {} -->", " * {}", "-- {}", "; {}", ".. {}", "REM {}", "% {}", "{}\r"]
LINES = {
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note": "GPL-2.0-only",
    "SPDX-License-Identifier: (MIT OR Apache-2.0)": "Apache-2.0,MIT",
    "SPDX-License-Identifier: MIT OR Apache-2.0 OR ISC": "Apache-2.0,ISC,MIT",
    "SPDX-License-Identifier: BSD-3-Clause AND (Zlib OR GPL-3.0-or-later)": "BSD-3-Clause,GPL-3.0-or-later,Zlib",
    "SPDX-License-Identifier:LGPL-2.1-or-later": "LGPL-2.1-or-later",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License": "CC-BY-SA-3.0",
    "This text is available under the Creative Commons Attribution-NonCommercial-NoDerivs 2.5 Generic License": "CC-BY-NC-ND-2.5",
    "see https://creativecommons.org/licenses/by-nc-sa/4.0/legalcode for terms": "CC-BY-NC-SA-4.0",
    "http://creativecommons.org/licenses/by/3.0/de/": "CC-BY-3.0",
    "To the extent possible under law: https://creativecommons.org/publicdomain/zero/1.0/": "CC0-1.0",
    "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication": "CC0-1.0",
}
NOTHING = ["SPDX-License-Identifier: LicenseRef-Proprietary", "The SPDX-License-Identifier tag is explained below.", "Creative Commons is a nonprofit organization with a license page.", "the name of the author is on the license", "no license here: MIT"]

SOURCE = "{a} Redistributions of source code must retain the above copyright notice, this list\n   of conditions and the following disclaimer."
BINARY = "{b} Redistributions in binary form must reproduce the above copyright notice, this\n   list of conditions and the following disclaimer in the documentation and/or\n   other materials provided with the distribution."
HEAD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
ADVERTISING = "{c} All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by {holder}."
NAMES = "{d} Neither the name of {holder} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
AUTHOR = "{d} The name of {holder} may not be used to endorse or promote products\n   derived from this software without specific prior written permission."
HOLDERS = ["Google Inc.", "the University of California, Berkeley", "the copyright holder", "Example e.V. (Ltd.)", "Jane Q. Public, Ph.D."]
MARKS = [("1.", "2.", "3.", "4."), ("*", "*", "*", "*"), ("(1)", "(2)", "(3)", "(4)"), ("a)", "b)", "c)", "d)")]


def commented(text, mark):
    return "\n".join(f"{mark}{x}".rstrip() for x in text.split("\n"))


def bsd_texts():
    for holder in HOLDERS:
        for a, b, c, d in MARKS:
            for mark in ("", "# ", "// ", " * "):
                own = {"a": a, "b": b, "c": c, "d": d, "holder": holder}
                for name, parts in {"BSD-2-Clause": [SOURCE, BINARY], "BSD-3-Clause": [SOURCE, BINARY, NAMES], "BSD-4-Clause": [SOURCE, BINARY, ADVERTISING, NAMES]}.items():
                    yield name, commented(HEAD + "\n" + "\n".join(parts).format(**own), mark)
                yield "BSD-3-Clause", commented(HEAD + "\n" + "\n".join([SOURCE, BINARY, AUTHOR]).format(**own), mark)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan.scan(df).collect()}
    return [got.get(k, "") for k in range(len(texts))]


def test_lines_in_comments(spark):
    cases = [(c.format(line), want) for line, want in LINES.items() for c in COMMENTS] + [(c.format(x), "") for x in NOTHING for c in COMMENTS]
    padded = [(f"import this\n{t}\n\nint main() {{}}\n", want) for t, want in cases]
    wrong = [(t, want, got) for (t, want), got in zip(cases + padded, found(spark, [t for t, _ in cases + padded]), strict=True) if got != want]
    assert not wrong, wrong[:5]
    assert len(cases) > 200


def test_bsd_clauses_of_any_holder(spark):
    cases = list(bsd_texts())
    wrong = [(t, want, got) for (want, t), got in zip(cases, found(spark, [t for _, t in cases]), strict=True) if got != want]
    assert not wrong, (len(wrong), wrong[:2])


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(k, f"good text {k}" if k % 2 else f"BUY now {k}!!") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    stray = spark.range(1000, 9000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    plain = {r.doc_id for r in nbsvm.training_rows(docs, labels, nbsvm.held_out, 40).collect()}
    assert {r.doc_id for r in nbsvm.training_rows(docs, labels.unionByName(stray), nbsvm.held_out, 40).collect()} == plain and len(plain) == 40
    # A document of many rows is one of the sample.
    first = min(plain)
    many = docs.unionByName(docs.filter(F.col("doc_id") == first).crossJoin(spark.range(300)).select("doc_id", F.concat("text", F.col("id").cast("string")).alias("text")))
    got = nbsvm.training_rows(many, labels, nbsvm.held_out, 40).collect()
    assert {r.doc_id for r in got} == plain and len(got) == 40
    assert nbsvm.training_rows(odd(spark, []), labels, nbsvm.held_out).count() == 0


@pytest.mark.parametrize("one", [3, 11, 13])
def test_no_language_with_a_training_row_is_lost(spark, one):
    rows = [(k, f"some words of text number {k}", "en") for k in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    same = spark.range(3000).select(F.lit(one).cast("long").alias("doc_id"), F.concat(F.lit("zz zzz "), F.col("id").cast("string")).alias("text"), F.lit("zz").alias("lang"))
    alike = spark.range(3000).select(F.lit(one).cast("long").alias("doc_id"), F.lit("yy yyy").alias("text"), F.lit("yy").alias("lang"))
    held = {r.lang: r.n for r in langid.training_rows(df.unionByName(same).unionByName(alike), 50).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert held == {"en": 50, "zz": 50, "yy": 1}


def test_long_texts_are_counted_like_short_ones(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "Bc", " ", "  ", "é", "1", "中"]) for _ in range(rng.randint(1, 400))).encode() for _ in range(50)] + [b"", b" ", b"x" * 700]
    whole = langid.counts(texts)
    for most in (1, 5, 64):
        monkeypatch.setattr(langid, "TOGETHER", most)
        assert np.array_equal(langid.counts(texts), whole)
