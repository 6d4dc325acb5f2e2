"""The text functions, output checks and grades for SQL users, as SQL functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewell.functions import strict_json

_WHITE = r"[\\s\\x1c-\\x1f\\x85\\p{Z}]"
_WORD = r"[\\p{L}\\p{N}_]"


def _normal(t: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower({t}), '[!-/:-@\\\\[-`{{-~]', ''), '(?<!{_WORD})(a|an|the)(?!{_WORD})', ' ')"
    return f"array_join(filter(split({bare}, '{_WHITE}+'), z -> z <> ''), ' ')"


def _words(normal: str) -> str:
    return f"filter(split({normal}, ' '), z -> z <> '')"


def _f1(p: str, g: str) -> str:
    """As functions.text.token_f1: both sorted together by word, and walked once."""
    side = lambda c, k: f"transform({c}, z -> named_struct('w', z, 'side', {k}))"
    met = "s.w = x.w AND s.held > 0"
    step = f"named_struct('w', x.w, 'held', CASE WHEN x.side = 0 THEN if(s.w = x.w, s.held, 0) + 1 WHEN {met} THEN s.held - 1 ELSE 0 END, 'n', CASE WHEN x.side = 1 AND {met} THEN s.n + 1 ELSE s.n END)"
    shared = f"aggregate(array_sort(concat({side(p, 0)}, {side(g, 1)})), named_struct('w', '', 'held', 0, 'n', 0), (s, x) -> {step}, s -> s.n)"
    return f"CASE WHEN size({p}) + size({g}) = 0 THEN 1.0D ELSE 2.0D * {shared} / (size({p}) + size({g})) END"


_FIELDS = "STRUCT<json: BOOLEAN, names: ARRAY<STRING>, ok: BOOLEAN, ans: STRING, ev: STRING>"
_GRADE = "STRUCT<v0_pass: BOOLEAN, v0_failure: STRING, answered: BOOLEAN, answerable_correct: BOOLEAN, em: DOUBLE, f1: DOUBLE, gold_answerable: BOOLEAN>"


def _text_of(field: str) -> str:
    return f"try_variant_get(try_parse_json(t), '$.{field}', 'string')"


def _type_of(field: str) -> str:
    return f"schema_of_variant(try_variant_get(try_parse_json(t), '$.{field}', 'variant'))"


_NO_NUMBER = strict_json.NO_NUMBER.replace("\\", "\\\\")
_STRINGS = f"{_type_of('ans')} = 'STRING' AND {_type_of('ev')} = 'STRING'"
_BLANK = "NOT {} RLIKE '[^\\\\s\\\\x1c-\\\\x1f\\\\x85\\\\p{{Z}}]'"

#: Name, and what follows it in its declaration.
FUNCTIONS = {
    "normalize_answer": f"(t STRING) RETURNS STRING RETURN {_normal('t')}",
    "first_sentence": "(t STRING) RETURNS STRING RETURN substring_index(t, '. ', 1)",
    "answer_words": f"(t STRING) RETURNS ARRAY<STRING> RETURN {_words('normalize_answer(t)')}",
    "word_f1": f"(p ARRAY<STRING>, g ARRAY<STRING>) RETURNS DOUBLE RETURN {_f1('p', 'g')}",
    "token_f1": "(a STRING, b STRING) RETURNS DOUBLE RETURN word_f1(answer_words(a), answer_words(b))",
    "exact_match": "(a STRING, b STRING) RETURNS DOUBLE RETURN CAST(normalize_answer(a) = normalize_answer(b) AS DOUBLE)",
    "plain_json": f"(t STRING) RETURNS STRING RETURN CASE WHEN contains(t, 'NaN') OR contains(t, 'Infinity') THEN regexp_replace(t, '{_NO_NUMBER}', '0') ELSE t END",
    "is_strict_json": """(t STRING) RETURNS BOOLEAN RETURN coalesce(size(try_variant_get(try_parse_json(concat('[', t, ']')), '$', 'array<variant>')) = 1
      AND map_keys(try_variant_get(try_parse_json(concat('{"r":', t, '}')), '$', 'map<string,variant>')) = array('r'), false)""",
    "v0_fields": f"""(t STRING) RETURNS {_FIELDS} RETURN CASE WHEN is_strict_json(t) THEN named_struct('json', true, 'names', array_sort(array_distinct(json_object_keys(t))),
      'ok', CASE WHEN {_type_of('ok')} = 'BOOLEAN' THEN {_text_of('ok')} = 'true' END, 'ans', CASE WHEN {_STRINGS} THEN {_text_of('ans')} END, 'ev', CASE WHEN {_STRINGS} THEN {_text_of('ev')} END) END""",
    "v0_label": f"""(f {_FIELDS}, document STRING) RETURNS STRING RETURN CASE WHEN f IS NULL THEN 'not_json' WHEN f.ok IS NULL OR f.names IS NULL THEN 'bad_schema' WHEN NOT f.ok AND f.names = array('ok') THEN NULL
      WHEN NOT f.ok OR f.names <> array('ans', 'ev', 'ok') OR f.ans IS NULL THEN 'bad_schema' WHEN {_BLANK.format('f.ans')} OR {_BLANK.format('f.ev')} THEN 'empty_field'
      WHEN NOT contains(document, f.ev) THEN 'ev_not_in_doc' WHEN NOT contains(f.ev, f.ans) THEN 'ans_not_in_ev' END""",
    "v0_check": "(output STRING, document STRING) RETURNS STRING RETURN v0_label(v0_fields(plain_json(coalesce(output, ''))), document)",
    "v0_grade": f"""(failure STRING, f {_FIELDS}, answers ARRAY<STRING>) RETURNS {_GRADE} RETURN named_struct('v0_pass', failure IS NULL, 'v0_failure', failure,
      'answered', failure IS NULL AND coalesce(f.ok, false), 'answerable_correct', failure IS NULL AND coalesce(f.ok, false) = (size(answers) > 0),
      'em', CASE WHEN failure IS NULL AND f.ok AND size(answers) > 0 THEN CAST(exists(transform(answers, y -> {_normal('y')}), y -> y = {_normal('f.ans')}) AS DOUBLE) ELSE 0.0D END,
      'f1', CASE WHEN failure IS NULL AND f.ok AND size(answers) > 0 THEN array_max(transform(transform(answers, y -> {_normal('y')}), y -> {_f1(_words(_normal('f.ans')), _words('y'))})) ELSE 0.0D END,
      'gold_answerable', size(answers) > 0)""",
    "grade": f"(output STRING, document STRING, answers ARRAY<STRING>) RETURNS {_GRADE} RETURN v0_grade(v0_check(output, document), v0_fields(plain_json(coalesce(output, ''))), answers)",
}


def register(spark: SparkSession) -> None:
    strict_json.take_last_key(spark)
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
