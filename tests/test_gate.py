"""Output checks and grades: fixed cases, a strict parser, and properties of F1."""

from __future__ import annotations

import json
import random
import string
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import sql, strict_json, text
from tidewell.operators import gate, validator

DOC = "The ferry Marlin leaves Tarvik at noon. It carries forty cars and a post van."
GOLDS = ["forty cars", "40 cars"]


def told(**fields) -> str:
    return json.dumps(fields)


def altered(**change) -> str:
    """A right answer with some fields put in another way; None takes a field out."""
    return told(**{k: v for k, v in ({"ok": True, "ans": "forty cars", "ev": "carries forty cars"} | change).items() if v is not None})


#: For each label, outputs that must get it, whatever the gold answers are.
FAILING = {
    "not_json": ["", None, "It carries forty cars.", altered()[:-1], f"Answer: {altered()}", f"{altered()} {altered()}", "{'ok': true}"],
    "bad_schema": ["[]", "true", "7", '"ok"', told(), told(ok="true"), told(ok=0), told(ok=None), told(ok=False, ans="noon"), told(ok=False, ev="at noon"), told(ok=True), altered(ans=None), altered(ev=None), altered(ans=40), altered(ev=["carries forty cars"]), altered(why="x"), altered(ok=False), '{"ok": NaN}', "-Infinity", '{"ok": true, "ok": 1}'],
    "empty_field": [altered(ans=""), altered(ev=" "), altered(ans="\t\n"), altered(ans="", ev="not there")],
    "ev_not_in_doc": [altered(ev="carries  forty cars"), altered(ev="Carries forty cars"), altered(ans="fifty", ev="carries fifty cars"), altered(ans="elsewhere", ev="It sank.")],
    "ans_not_in_ev": [altered(ans="noon"), altered(ans="Forty cars"), altered(ans="forty cars and"), altered(ans="not there")],
}
#: Outputs that pass, with gold answers: exact match, F1 (None: not stated) and whether the question was rightly answered.
PASSING = [
    (altered(), GOLDS, 1.0, 1.0, True),
    (told(ok=False), [], 0.0, 0.0, True),
    (told(ok=False), GOLDS, 0.0, 0.0, False),
    (altered(), [], 0.0, 0.0, False),
    (f"  {altered()}\n", GOLDS, 1.0, 1.0, True),
    (altered(ans="a post van", ev="and a post van."), ["bus", "Post van!"], 1.0, 1.0, True),
    (altered(ans="cars", ev="forty cars"), GOLDS, 0.0, 2 / 3, True),
    (altered(ans="noon", ev="at noon"), GOLDS, 0.0, 0.0, True),
    ('{"ok": false, "ans": "x", "ok": true, "ans": "forty cars", "ev": "forty cars"}', GOLDS, 1.0, 1.0, True),
]


def test_labels_and_grades(spark):
    cases = [(out, golds, label, 0.0, 0.0, False) for label, outs in FAILING.items() for out in outs for golds in ([], GOLDS)]
    cases += [(out, golds, None, em, f1, right) for out, golds, em, f1, right in PASSING]
    df = spark.createDataFrame([(n, c[0], DOC, c[1]) for n, c in enumerate(cases)], "id int, output string, document string, answers array<string>")
    graded = validator.graded(df)
    sql.register(spark)
    by_sql = graded.select("*", F.expr("grade(output, document, answers)").alias("g"), F.expr("v0_check(output, document)").alias("label"))
    fields = ("v0_pass", "v0_failure", "answered", "answerable_correct", "em", "f1", "gold_answerable")
    for r in by_sql.collect():
        assert r.label == r.v0_failure and [r.g[c] for c in fields] == [r[c] for c in fields], cases[r.id]
        out, golds, label, em, f1, right = cases[r.id]
        assert (r.v0_failure, r.v0_pass, r.answerable_correct, r.gold_answerable) == (label, label is None, right, bool(golds)), out
        assert r.em == em and r.f1 == pytest.approx(f1), out


def test_json_as_a_strict_parser_has_it(spark):
    rng = random.Random(1)
    bodies = ['{"ok": false}', "[1, 2]", '"x"', "12", "null", "tru", "{'a': 1}", '{"a": 1,}', '{"a": "x\\u00e9"}', '{"a" 1}', "[", "{}", "]", "NaN", '{"a": -Infinity, "b": "NaN"}', '{"a": 1, "a": [NaN]}', "1NaN", "--Infinity", '"Infinity']
    texts = list({a + b + c for b in bodies for a in ("", " ", "x", "[", '{"r":') for c in ("", "\n", " x", "}", "]", "}}", "] [", " {}", "} ]", ",1")})
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    strict_json.take_last_key(spark)
    got = dict(df.select("id", strict_json.is_json(strict_json.plain(F.col("t")))).collect())

    def strict(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    assert [t for n, t in enumerate(texts) if got[n] != strict(t)] == []


def _f1(p, g):
    c = sum((Counter(p) & Counter(g)).values())
    return 1.0 if not p and not g else 0.0 if not c else 2 * c / (len(p) + len(g))


def test_f1_as_counted_by_hand(spark):
    words = ["a1", "b", "b", "c", "d"]
    rng = random.Random(2)
    rows = [(n, [rng.choice(words) for _ in range(rng.randint(0, 5))], [rng.choice(words) for _ in range(rng.randint(0, 5))]) for n in range(300)]
    df = spark.createDataFrame(rows, "id int, p array<string>, g array<string>")
    for r in df.select("id", "p", "g", text.token_f1(F.col("p"), F.col("g")).alias("f"), text.token_f1(F.col("g"), F.col("p")).alias("b")).collect():
        assert r.f == pytest.approx(_f1(r.p, r.g)) and r.f == r.b and 0 <= r.f <= 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=60))
def test_normal_form_has_no_marks_and_no_double_blanks(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode().replace("\x00", "") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select(text.normalize_answer(F.col("t")).alias("n")).collect():
        assert not set(r.n) & set(string.punctuation) and "  " not in r.n and r.n == r.n.strip()


def test_articles_and_white_space(spark):
    df = spark.createDataFrame([("The cat and an  ape",), ("theatre \u00e1 an\u00e8",), ("x a\u0301",)], "t string")
    # A combining mark is no letter, so the article before it goes.
    assert [r.n for r in df.select(text.normalize_answer(F.col("t")).alias("n")).collect()] == ["cat and ape", "theatre \u00e1 an\u00e8", "x \u0301"]


def test_abstaining_on_a_balanced_set(spark):
    rows = [(str(n), "d. e", ["d"] if n % 2 else []) for n in range(10)]
    df = spark.createDataFrame(rows, "id string, document string, answers array<string>")
    r = gate.report(validator.graded(gate.outputs(df, baseline="abstain")), "baseline:abstain").first()
    assert (r.n, r.v0_pass_rate, r.answerability_acc, r.coverage, r.selective_em, r.selective_f1, r.overall_em, r.overall_f1) == (10, 1.0, 0.5, 0.0, 0.0, 0.0, 0.5, 0.5)


def test_report_of_no_rows_and_as_json(spark):
    none = spark.createDataFrame([], "id string, document string, answers array<string>")
    r = gate.report(validator.graded(gate.outputs(none, baseline="abstain")), "m").first()
    assert r.n == 0 and r.v0_pass_rate is None and r.selective_em == 0.0
    one = spark.createDataFrame([("1", DOC, GOLDS, "prose")], "id string, document string, answers array<string>, output string")
    told = json.loads(gate.report_json(validator.graded(one), "m").first().report)
    assert told["v0_failures"] == {"not_json": 1} and told["n"] == 1


def test_predictions_or_baseline(spark):
    df = spark.createDataFrame([("1", DOC, [])], "id string, document string, answers array<string>")
    with pytest.raises(ValueError):
        gate.outputs(df)
    preds = spark.createDataFrame([("1", "old", 1), ("1", "new", 2), ("9", "x", 3)], "id string, output string, line long")
    assert [r.output for r in gate.outputs(df, preds=preds).collect()] == ["new"]
