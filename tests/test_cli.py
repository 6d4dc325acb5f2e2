"""Commands end to end, and the SQL functions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewell import cli
from tidewell.functions import sql, text


def test_evalset_then_gate(spark, tmp_path, capsys):
    raw = [{"id": str(k), "question": "q", "context": "Ann won. She left.", "answers": {"text": ["Ann", "Ann won"] if k % 2 else []}} for k in range(10)]
    (tmp_path / "raw.json").write_text("\n".join(map(json.dumps, raw)))
    cli.main(["evalset", "--raw", str(tmp_path / "raw.json"), "--out", str(tmp_path / "eval"), "--each", "3"])
    assert json.loads(capsys.readouterr().out) == {"answerable": 3, "unanswerable": 3}
    cli.main(["gate", "--eval", str(tmp_path / "eval"), "--baseline", "abstain", "--out", str(tmp_path / "r.json")])
    told = json.loads((tmp_path / "r.json").read_text())
    assert (told["n"], told["v0_pass_rate"], told["overall_em"], told["v0_failures"]) == (6, 1.0, 0.5, {})
    ids = [json.loads(x)["id"] for p in sorted((tmp_path / "eval").glob("part-*")) for x in p.read_text().splitlines()]
    lines = [{"id": i, "output": "stale"} for i in ids] + [{"id": i, "output": json.dumps({"ok": True, "ans": "Ann won", "ev": "Ann won"})} for i in ids]
    (tmp_path / "preds.json").write_text("\n".join(map(json.dumps, lines)))
    capsys.readouterr()
    cli.main(["gate", "--eval", str(tmp_path / "eval"), "--preds", str(tmp_path / "preds.json")])
    told = json.loads(capsys.readouterr().out)
    assert (told["coverage"], told["selective_em"], told["overall_em"]) == (1.0, 0.5, 0.5)
    with pytest.raises(SystemExit):
        cli.main(["gate", "--eval", "x"])


def test_train_then_tokenize(spark, tmp_path, capsys):
    docs = f"{SMALL}/documents.parquet"
    cli.main(["train-tokenizer", "--documents", docs, "--out", str(tmp_path / "m"), "--vocab-size", "320"])
    assert json.loads(capsys.readouterr().out) == {"merges": 60, "vocab_size": 320}
    cli.main(["tokenize", "--documents", docs, "--merges", str(tmp_path / "m"), "--out", str(tmp_path / "t"), "--flush-every", "20000", "--val-tokens", "30000"])
    meta = json.loads(capsys.readouterr().out)
    size = lambda s: sum(p.stat().st_size for p in (tmp_path / "t" / s).glob("*.bin")) // 2
    assert meta["val_tokens"] == size("val") >= 30_000 and meta["train_tokens"] == size("train") and meta["total_tokens"] == size("val") + size("train")


def test_credentials_are_taken_in_order(monkeypatch):
    monkeypatch.setenv("TIDEWELL_B", "b")
    monkeypatch.setenv("TIDEWELL_A", "")
    assert cli.credential(["TIDEWELL_A", "TIDEWELL_B"]) == "b" and cli.credential([]) is None


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert docs.filter(F.expr("normalize_answer(text)") != text.normalize_answer(F.col("text"))).count() == 0
    got = spark.sql("SELECT token_f1('Prize in Physics', 'Nobel Prize') a, exact_match('The Cat!', 'cat') b, first_sentence('A. B') c, token_f1('', 'the') d").first()
    assert (round(got.a, 6), got.b, got.c, got.d) == (0.4, 1.0, "A", 1.0)
