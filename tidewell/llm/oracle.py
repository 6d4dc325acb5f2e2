"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from . import chat_tree as ct
from . import decontaminate as dc
from . import license_scan as ls
from . import phrases as ph
from . import quality_rules as qr

_SPACE = r"\x20\x09-\x0D"


def quality_sql() -> str:
    boiler = qr.BOILERPLATE.replace("'", "''")
    return rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[{_SPACE}]+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT doc_id, i, list_slice(w, i, i + {qr.WINDOW - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {qr.WINDOW - 2})) AS i FROM w WHERE len(w) >= {qr.WINDOW})),
    d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
    r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, i + unnest(range({qr.WINDOW})) AS k FROM d) GROUP BY 1),
    l AS (SELECT doc_id, l, len(regexp_extract_all(l, '[^{_SPACE}]+')) AS n_words, length(regexp_replace(l, '[^#*$%&|<>!?]+', '', 'g')) AS marks,
      len(regexp_extract_all(l, '[!?]{{2,}}')) AS bangs, len(regexp_extract_all(l, '[!?]')) AS single
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^{_SPACE}]')),
    f AS (SELECT doc_id, l, (marks - single + bangs) * 100 > {qr.MOST_MARKS} * n_words OR NOT regexp_matches(l, '\p{{L}}') OR regexp_matches(l, '{qr.NAVIGATION}')
      OR (n_words >= 5 AND NOT regexp_matches(l, '\p{{Ll}}')) OR regexp_matches(l, '{boiler}') AS fails FROM l),
    s AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup, sum(length(l)) AS total, coalesce(sum(length(l)) FILTER (WHERE fails), 0) AS lost FROM f GROUP BY 1),
    m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{_SPACE}]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^{qr.SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars, coalesce(total, 0) AS total
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
      NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= {qr.MOST_LOST} * total AS kept FROM m"""


def license_sql() -> str:
    known = ", ".join(f"('{s}', {n})" for s, n in ls.known_sentences().items())
    rules = ", ".join(f"('{licence}', '{ids}')" for licence, ids in ls.numbered_rules())
    ends = r"[.!?;:]+[ \t\n\x0B\f\r]+|\n"
    wide = r"[.!?;:]+[ \t\n\x0B\f\r]+|\n[ \t\n\x0B\f\r]*\n"
    bare = f"regexp_replace(text, '(?m){ls.MARKS}', '', 'g')"
    for stop, put in ls.INNER_STOPS:
        bare = f"regexp_replace({bare}, '{stop}', '{put.replace('$', chr(92))}', 'g')"
    return rf"""WITH known(sentence, sid) AS (VALUES {known}), rules(license, ids) AS (VALUES {rules}),
    docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {bare} AS text FROM documents WHERE text IS NOT NULL),
    ways AS (SELECT row, doc_id, 0 AS way, regexp_split_to_array(text, '{ends}') AS s FROM docs UNION ALL SELECT row, doc_id, 1, regexp_split_to_array(text, '{wide}') FROM docs),
    cut AS (SELECT row, doc_id, way, i AS pos, trim(regexp_replace(lower(s[i]), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS sentence FROM (SELECT row, doc_id, way, s, unnest(range(1, len(s) + 1)) AS i FROM ways)),
    found AS MATERIALIZED (SELECT row, doc_id, way, string_agg('<' || sid || '>', ' ' ORDER BY pos) AS ids, count(*) AS n FROM cut JOIN known USING (sentence) GROUP BY 1, 2, 3),
    met AS MATERIALIZED (SELECT row, doc_id, way, license, r.ids FROM found f JOIN rules r ON contains(f.ids, r.ids)),
    most AS (SELECT * FROM met a WHERE NOT EXISTS (SELECT 1 FROM met b WHERE b.row = a.row AND b.way = a.way AND length(b.ids) > length(a.ids) AND contains(b.ids, a.ids))),
    told AS (SELECT row, doc_id, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses, count(DISTINCT license || ids) AS n_rules FROM most GROUP BY row, doc_id)
    SELECT doc_id, licenses, n_rules, n_sentences FROM told JOIN (SELECT row, max(n) AS n_sentences FROM found GROUP BY row) USING (row)"""


def decontamination_sql() -> str:
    """Seeds are lists of words here, so no hash, bit table or skipped position is shared with the query."""
    plain = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"
    bare = rf"trim(regexp_replace(regexp_replace({plain}, '({dc.UNSPACED})', ' \1 ', 'g'), ' +', ' ', 'g'))"
    mask = lambda m: f"[{', '.join(f'w[i + {k + 1}]' for k, x in enumerate(m) if x == '1')}]"
    of = lambda t, key: " UNION ALL ".join([
        *(f"SELECT {n} AS mask, {key}, i, {mask(m)} AS s FROM (SELECT {key}, w, unnest(range(0, len(w) - {len(m) - 1})) AS i FROM {t} WHERE len(w) >= {len(m)})" for n, m in enumerate(dc.MASKS)),
        f"SELECT {len(dc.MASKS)} + n AS mask, {key}, i, w[i + 1:i + n] AS s FROM (SELECT {key}, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM {t} JOIN short ON {'len(w) >= n' if t == 'docs' else 'len(w) = n'})",
    ])
    once = lambda key: " AND ".join(f"s IS DISTINCT FROM lag(s, {p}) OVER (PARTITION BY mask, {key} ORDER BY i)" for p in range(1, dc.REPEATED_WITHIN + 1))
    return rf"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, string_split({bare}, ' ') AS w FROM documents WHERE doc_id IS NOT NULL),
    named AS MATERIALIZED (SELECT item_id, string_split(t, ' ') AS w FROM (SELECT item_id, {bare} AS t FROM benchmark WHERE item_id IS NOT NULL) WHERE t <> ''),
    items AS MATERIALIZED (SELECT min(item_id) AS item, w FROM named GROUP BY w),
    short AS (SELECT DISTINCT len(w) AS n FROM items WHERE len(w) < {dc.SHORTEST}),
    ds AS (SELECT mask, row, i, s, {once("row")} AS once FROM ({of("docs", "row")})),
    js AS (SELECT mask, item, i, s, {once("item")} AS once FROM ({of("items", "item")})),
    diagonals AS MATERIALIZED (SELECT DISTINCT row, item, ds.i - js.i AS d FROM ds JOIN js USING (mask, s) WHERE ds.once AND js.once),
    pairs AS (SELECT row, item, d, docs.w AS w, items.w AS v FROM diagonals JOIN docs USING (row) JOIN items USING (item)),
    equal AS (SELECT row, item, d, len(v) AS n, p FROM (SELECT row, item, d, w, v, unnest(range(greatest(0, d), least(len(w), len(v) + d))) AS p FROM pairs) WHERE w[p + 1] = v[p - d + 1]),
    marked AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY row, item, d ORDER BY p) > {dc.MOST_GAP}, true) AS opens FROM equal),
    numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY row, item, d ORDER BY p) AS island FROM marked),
    islands AS (SELECT row, item, d, n, island, CAST(count(*) AS INT) AS n_equal, CAST(max(p) - min(p) + 1 AS INT) AS n_words FROM numbered GROUP BY ALL),
    good AS (SELECT * FROM islands WHERE (n_equal >= {dc.LEAST_WORDS} OR 10 * n_equal >= {dc.LEAST_TENTHS} * n) AND 10 * n_equal >= {dc.LEAST_TENTHS} * n_words),
    per_row AS (SELECT row, item, count(*) AS k, max({{'n_equal': n_equal, 'n_words': n_words}}) AS b FROM good GROUP BY row, item)
    SELECT doc_id, item_id, max(k) AS n_overlaps, max(b).n_equal AS n_equal, max(b).n_words AS n_words
    FROM per_row JOIN (SELECT row, doc_id FROM docs) USING (row) JOIN (SELECT item, item_id FROM named JOIN items USING (w)) USING (item) GROUP BY doc_id, item_id"""


def chat_sql() -> str:
    """The digests from the rows themselves: no tree, token or template is shared with the query, but for the sizes of marks."""
    probe = ct.PROBE.replace("'", "''")
    # A doubled backslash, and one more in each mark that a text holds.
    longer = lambda t: rf"length({t}) + (length({t}) - length(replace({t}, '\', ''))) + (length({t}) - length(replace({t}, '</turn>', ''))) // 7 + (length({t}) - length(replace({t}, '<|', ''))) // 2 + coalesce(list_sum(list_transform(regexp_extract_all({t}, '#{{3,}}'), lambda x: length(x) - 2)), 0)"
    marks = len(ct.TURN) + len(":\n") + len(ct.TURN_END)
    return rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{probe}' UNION ALL SELECT -7, 1, 'assistant', '{probe}'),
    s AS (SELECT *, CASE WHEN role = '{ct.TRAINED_ROLE}' THEN text ELSE '' END AS loss, {longer("text")} + {longer("role")} + (length(role) - length(replace(role, ':', ''))) + {marks} AS size FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
    FROM s GROUP BY conv_id"""


def phrases_sql() -> str:
    """Every occurrence of every phrase, grouped."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"
    return rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
    w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
    g AS (SELECT lang, m, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, {ph.MOST + 1})) AS m) WHERE len(w) >= m)),
    f AS MATERIALIZED (SELECT lang, m, array_to_string(g, ' ') AS phrase, g AS w, count(*) AS f FROM g GROUP BY lang, m, g HAVING count(*) >= {ph.LEAST_COUNT}),
    cuts AS (SELECT lang, phrase, f AS a, k, {part(1, "k")} AS x, {part("k + 1", "m")} AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
    s AS (SELECT c.*, l.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * {ph.SCALE} // (l.f + r.f) AS BIGINT) AS score FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y),
    least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS z FROM s),
    inside AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(f) AS longest FROM (SELECT lang, w, f, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM f WHERE m > 2)) GROUP BY ALL),
    kept AS (SELECT lang, phrase, a, l, r, score FROM least LEFT JOIN inside USING (lang, phrase) WHERE z = 1 AND NOT coalesce(100 * longest >= {ph.INSIDE_PERCENT} * a, false)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {ph.TOP}"""


ORACLES = {"op4_spaced_seeds": decontamination_sql(), "op5_license_sentences": license_sql(), "op8_line_quality": quality_sql(), "op11_chat_prefix_tree": chat_sql(), "op13_suffix_phrases": phrases_sql()}
