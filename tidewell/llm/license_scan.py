"""Licence recognition by sentence rules, in DataFrame functions only.

Texts are cut into sentences, twice: with line ends as ends of sentences, and with lines joined, for notices
wrapped over lines; comment marks go first, so a line of marks alone is blank.  A normalised sentence (lower
case, runs of other characters than letters and digits as one space) that is known becomes its identifier; a
document's identifiers, in order, are matched against ordered rules, and a rule whose identifiers stand inside
those of a longer match is dropped.

Every known sentence holds a cue, so texts without one are passed over.  A cue's words may be parted by any run of
characters that normalising makes a space, so no text with a known sentence is lost by this; the SQL of the
query has no such test.

Defined results: null and blank texts have no sentence; rows without a match give no row; every other row gives
one, judged by itself, so equal rows give equal rows; rows without doc_id are scanned like others; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every known sentence holds one of these, as normalised.
CUES = ("licen", "released under", "permission", "redistribut", "warranty", "public domain", "publicdomain", "advertising materials", "copyright", "endorse or promote", "this software is provided", "this software for any purpose", "arising from the use")

#: Known sentences, normalised, by identifier.
SENTENCES: dict[str, str] = {
    "mit_ref": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_this": "this project is licensed under the mit license",
    "mit_terms": "this software is distributed under the terms of the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache_may_not": "you may not use this file except in compliance with the license",
    "apache_unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "bsd_redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_names_old": "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost_ref": "distributed under the boost software license version 1 0",
    "epl_1_plain": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
    "epl_2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl_2_slash": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl v20 html",
    "gpl_2_title": "gnu general public license version 2 june 1991",
    "gpl_3_title": "gnu general public license version 3 29 june 2007",
    "lgpl_21_title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl_3_title": "gnu lesser general public license version 3 29 june 2007",
    "agpl_3_title": "gnu affero general public license version 3 19 november 2007",
    "apache_title": "apache license version 2 0 january 2004 http www apache org licenses",
    "mpl_title": "mozilla public license version 2 0",
    "bsd_ref": "released under the bsd license",
    "bsd_licensed": "licensed under the bsd license",
    "mpl_ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0": "public domain dedication cc0 1 0 universal",
    "bsd_advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_advertising_old": "all advertising materials mentioning features or use of this software must display the following acknowledgment",
    "public_domain": "this work is in the public domain",
    "reserved_no_license": "no license express or implied is granted",
}
#: Sentences with a version, and the licence each gives; {v} is the version with a space for its point.
VERSIONED: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("apache_ref", "licensed under the apache license version {v}", "Apache-{d}", ("1.1", "2.0")),
    ("apache_released", "released under the apache license version {v}", "Apache-{d}", ("1.1", "2.0")),
    ("gpl_ref", "this work is licensed under the gnu general public license version {v}", "GPL-{d}", ("2", "2.0", "3", "3.0")),
    ("gpl_licensed", "licensed under the gnu general public license version {v}", "GPL-{d}", ("2", "2.0", "3", "3.0")),
    ("gpl_released", "released under the gnu general public license version {v}", "GPL-{d}", ("2", "2.0", "3", "3.0")),
    ("lgpl_ref", "licensed under the gnu lesser general public license version {v}", "LGPL-{d}", ("2.1", "3", "3.0")),
    ("agpl_ref", "licensed under the gnu affero general public license version {v}", "AGPL-{d}", ("3", "3.0")),
    ("mpl_licensed", "licensed under the mozilla public license version {v}", "MPL-{d}", ("1.1", "2.0")),
)
CREATIVE_COMMONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CREATIVE_COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
SPDX = (
    "MIT", "MIT-0", "ISC", "0BSD", "Zlib", "BSL-1.0", "Apache-1.1", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "EPL-1.0", "EPL-2.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "Unlicense",
    "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
)

#: Ordered rules of more than one sentence, and single sentences of SENTENCES that name a licence.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_grant",)),
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_licensed",)),
    ("MIT", ("mit_this",)),
    ("MIT", ("mit_terms",)),
    ("ISC", ("isc_grant",)),
    ("Apache-2.0", ("apache_ref 2.0", "apache_may_not", "apache_unless", "apache_see")),
    ("Apache-2.0", ("apache_unless", "apache_see")),
    *(("BSD-4-Clause", ("bsd_redist", "bsd_source", "bsd_binary", x, *end)) for x in ("bsd_advertising", "bsd_advertising_old") for end in (("bsd_names", "bsd_disclaimer"), ("bsd_names",), ())),
    ("BSD-3-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_names", "bsd_disclaimer")),
    ("BSD-3-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_names_old", "bsd_disclaimer")),
    ("BSD-3-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-3-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_names_old")),
    ("BSD-2-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_disclaimer")),
    ("BSD-2-Clause", ("bsd_redist", "bsd_source", "bsd_binary")),
    ("BSD", ("bsd_redist", "bsd_source")),
    ("Zlib", ("zlib_as_is", "zlib_liable", "zlib_grant")),
    ("Zlib", ("zlib_grant",)),
    ("BSL-1.0", ("boost_grant",)),
    ("BSL-1.0", ("boost_ref",)),
    ("EPL-1.0", ("epl_1_plain",)),
    ("EPL-2.0", ("epl_2",)),
    ("EPL-2.0", ("epl_2_slash",)),
    ("GPL-2.0", ("gpl_2_title",)),
    ("GPL-3.0", ("gpl_3_title",)),
    ("LGPL-2.1", ("lgpl_21_title",)),
    ("LGPL-3.0", ("lgpl_3_title",)),
    ("AGPL-3.0", ("agpl_3_title",)),
    ("Apache-2.0", ("apache_title",)),
    ("MPL-2.0", ("mpl_title",)),
    ("BSD", ("bsd_ref",)),
    ("BSD", ("bsd_licensed",)),
    ("MPL-2.0", ("mpl_ref",)),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public_domain",)),
    ("CC0-1.0", ("cc0",)),
)


def _spaced(x: str) -> str:
    return "".join(c if c.isalnum() else " " for c in x.lower())


def sentences() -> dict[str, str]:
    """All known sentences by identifier."""
    out = dict(SENTENCES)
    for name, text, _, versions in VERSIONED:
        out |= {f"{name} {v}": text.format(v=_spaced(v)) for v in versions}
    for kind in CREATIVE_COMMONS:
        for v in CREATIVE_COMMONS_VERSIONS:
            for verb in ("licensed under", "released under", "this work is licensed under"):
                out[f"cc {kind} {v} {verb}"] = f"{verb} cc {_spaced(kind)} {_spaced(v)}"
    return out | {f"spdx {x}": f"spdx license identifier {_spaced(x)}" for x in SPDX}


def rules() -> list[tuple[str, tuple[str, ...]]]:
    """All rules, longest first: a licence and the identifiers that give it in this order."""
    out = list(RULES)
    for name, _, licence, versions in VERSIONED:
        out += [(licence.format(d=v if "." in v else f"{v}.0"), (f"{name} {v}",)) for v in versions]
    out += [(f"CC-{x.split()[1]}-{x.split()[2]}", (x,)) for x in sentences() if x.startswith("cc ")]
    out += [(x, (f"spdx {x}",)) for x in SPDX]
    return sorted(out, key=lambda r: -len(r[1]))


#: Notices of the GNU family: name in the notice, licence, versions.
GNU = (("general", "GPL", ("1", "2", "3")), ("lesser general", "LGPL", ("2.1", "3")), ("library general", "LGPL", ("2",)), ("affero general", "AGPL", ("3",)))
#: Comment marks where a line starts or ends, and stops that end no sentence ("v. 2", and that of the GNU notice) with
#: what stands for them; $1 and $2 are what was met.  After these stand forms of which a part is free: SPDX lines, of expressions too (_OPERATORS at most), the
#: clause on names in BSD licences, whoever holds them, and Creative Commons by name and by address.
MARKS = r"^[ \t]*(?:<!--|/\*+|\*+/?|//+|#+|;+|--+|%+)(?:[ \t\r]|$)|[ \t]*(?:\*+/|-->)[ \t]*\r?$"
_INNER = ((r"(?i)(^|[^\p{L}\p{N}])v\.[ \t\n\x0B\f\r]*([0-9])", "$1v $2"), (r"(?i)(Free[ \t\n\x0B\f\r]+Software[ \t\n\x0B\f\r]+Foundation)[ \t\n\x0B\f\r]*[;:][ \t\n\x0B\f\r]+", "$1, "))

_OPERATORS = 6
_SPDX_LINE = r"SPDX-License-Identifier[ \t]*:[ \t]*"
_SPDX_PUT = "SPDX-License-Identifier: "
_NAMES = r"(?i)(?:neither\s+)?the\s+names?\s+of\s+[\s\S]{1,300}?endorse\s+or\s+promote\s+products\s+derived\s+from\s+this\s+software\s+without\s+(?:specific\s+)?prior\s+written\s+permission"
_CC_NAMES = (
    ("BY-NC-SA", r"Attribution[- ]+Non-?Commercial[- ]+Share-?Alike"),
    ("BY-NC-ND", r"Attribution[- ]+Non-?Commercial[- ]+No-?Deriv(?:ative)?s(?: Works)?"),
    ("BY-NC", r"Attribution[- ]+Non-?Commercial"),
    ("BY-SA", r"Attribution[- ]+Share-?Alike"),
    ("BY-ND", r"Attribution[- ]+No-?Deriv(?:ative)?s(?: Works)?"),
    ("BY", r"Attribution"),
)
INNER_STOPS = (
    *_INNER,
    (r"(?m)^[ \t]*\(?[0-9a-d]\)[ \t]+", ""),
    *(((rf"(?i)({_SPDX_LINE}[^\n]*?)[ \t)]+(?:OR|AND)[ \t(]+", f"$1\n{_SPDX_PUT}"),) * _OPERATORS),
    (rf"(?i){_SPDX_LINE}[( \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)", "\n\nSPDX-License-Identifier $1\n\n"),
    (_NAMES, f"\n\n{SENTENCES['bsd_names']}.\n\n"),
    *((rf"(?i)Creative\s+Commons\s+{name}\s+(?:version\s+)?v?([1-4]\.[05])(?:\s+\p{{L}}+){{0,4}}?\s+Licen[sc]e", f"\n\nlicensed under CC {kind} $1\n\n") for kind, name in _CC_NAMES),
    (r"(?i)https?://creativecommons\.org/licenses/(by(?:-nc)?(?:-nd|-sa)?)/([1-4]\.[05])[^\s>)]*", "\n\nlicensed under CC $1 $2\n\n"),
    (r"(?i)https?://creativecommons\.org/publicdomain/zero/1\.0[^\s>)]*", f"\n\n{SENTENCES['cc0']}\n\n"),
    (r"(?i)CC0 1\.0 Universal", f"\n\n{SENTENCES['cc0']}\n\n"),
)


def notices() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Sentences of real notices that are not in sentences(), and their rules."""
    known = {"apache_notice": "licensed under the apache license version 2 0 the license"}
    found = [("Apache-2.0", ("apache_notice", "apache_may_not", "apache_unless", "apache_see")), ("Apache-2.0", ("apache_notice",))]
    for name, licence, versions in GNU:
        for v in versions:
            terms = f"you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software foundation"
            ends = {"or-later": f"either version {_spaced(v)} of the license or at your option any later version", "only": f"version {_spaced(v)} of the license"}
            for kind, end in ends.items():
                known[f"gnu {name} {v} {kind}"] = f"{terms} {end}"
                found.append((f"{licence}-{v if '.' in v else f'{v}.0'}-{kind}", (f"gnu {name} {v} {kind}",)))
    return known, found


def _bare(text: Column | str) -> Column:
    """The text without comment marks and inner stops."""
    out = F.regexp_replace(text, f"(?md){MARKS}", "")
    for stop, put in INNER_STOPS:
        out = F.regexp_replace(out, stop, put)
    return out


def known_sentences() -> dict[str, int]:
    """Every known sentence and its number."""
    return {v: n for n, v in enumerate((sentences() | notices()[0]).values())}


def numbered_rules() -> list[tuple[str, str]]:
    """Every rule: a licence, and the numbers of its sentences as <a> <b> in order."""
    more, more_rules = notices()
    number = {k: n for n, k in enumerate(sentences() | more)}
    return [(licence, " ".join(f"<{number[k]}>" for k in ids)) for licence, ids in rules() + more_rules]


def cue_pattern() -> str:
    """Java's pattern of a raw text whose normalised form may hold a cue."""
    return "(?iu)" + "|".join(r"[^\p{L}\p{N}]+".join(c.split()) for c in CUES)


def sentence_ids(docs: DataFrame) -> DataFrame:
    """(row, doc_id, way, pos, sid): known sentences; row numbers the rows of docs, way 0 cuts at line ends, 1 joins lines."""
    known = docs.sparkSession.createDataFrame(list(known_sentences().items()), "sentence string, sid int")
    cued = docs.filter(F.col("text").rlike(cue_pattern())).select(F.monotonically_increasing_id().alias("row"), "doc_id", _bare("text").alias("text"))
    ways = F.array(F.struct(F.lit(0).alias("way"), F.split("text", r"[.!?;:]+\s+|\n").alias("s")), F.struct(F.lit(1).alias("way"), F.split("text", r"[.!?;:]+\s+|\n\s*\n").alias("s")))
    cut = cued.select("row", "doc_id", F.explode(ways).alias("w")).select("row", "doc_id", "w.way", F.posexplode("w.s").alias("pos", "sentence"))
    plain = F.trim(F.regexp_replace(F.lower("sentence"), r"[^\p{L}\p{N}]+", " "))
    # The table of known sentences is fixed in this module, so its size is too.
    return cut.withColumn("sentence", plain).join(F.broadcast(known), "sentence").select("row", "doc_id", "way", "pos", "sid")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, n_rules, n_sentences): a row for each row with a licence; licenses is sorted, comma-joined."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sid"))), lambda x: F.concat(F.lit("<"), x.sid.cast("string"), F.lit(">"))), " ")
    per_way = sentence_ids(docs).groupBy("row", "doc_id", "way").agg(ids.alias("ids"), F.count("*").alias("n"))
    table = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("ids")) for a, b in numbered_rules()])
    matched = F.filter(table, lambda r: F.contains(F.col("ids"), r.ids))
    per_way = per_way.withColumn("m", matched)
    outer = F.filter("m", lambda r: ~F.exists("m", lambda o: (F.length(o.ids) > F.length(r.ids)) & F.contains(o.ids, r.ids)))
    per_way = per_way.select("row", "doc_id", "n", outer.alias("m"))
    rows = per_way.groupBy("row", "doc_id").agg(F.array_distinct(F.flatten(F.collect_list("m"))).alias("m"), F.max("n").alias("n_sentences")).filter(F.size("m") > 0)
    licenses = F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda r: r.license))), ",")
    return rows.select("doc_id", licenses.alias("licenses"), F.size("m").cast("long").alias("n_rules"), "n_sentences")
