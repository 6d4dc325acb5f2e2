"""A phrase that many benchmark items and many documents share."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import connection
from tidewell.llm import decontaminate
from tidewell.llm.oracle import ORACLES


def _rows(n: int):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("bcdfghklm") for _ in range(7))
    stem = "which of the following statements is always true"
    items = [(k, f"{stem} {' '.join(word() for _ in range(12))}") for k in range(n)]
    docs = [(k, f"{word()} {word()} {stem} {' '.join(word() for _ in range(20))}") for k in range(n)]
    docs[3] = (3, f"{word()} {items[5][1]} {word()}")
    docs[4] = (4, " . ".join(t for _, t in items))  # a dump of the benchmark
    docs += [(3, "repeated row"), (None, items[1][1]), (n, None), (n + 1, "")]
    return items + [(None, "no id of any kind but words enough to be an item"), (n, None)], docs


@pytest.mark.parametrize(("items_met", "hits_met"), [(4, 8), (64, 4096)])
def test_shared_stems_are_dealt_out_and_lose_nothing(spark, tmp_path, monkeypatch, items_met, hits_met):
    monkeypatch.setattr(decontaminate, "MET_ITEMS", items_met)
    monkeypatch.setattr(decontaminate, "MET_HITS", hits_met)
    n = 80
    items, docs = _rows(n)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.digest(df, benchmark).collect()}
    assert got == {(3, 5)} | {(4, k) for k in range(n)}


@pytest.mark.parametrize(("items", "hits"), [(1, 1), (1, 9_000), (700, 1), (700, 9_000)])
def test_keys_stay_small_and_every_pair_meets_once(spark, items, hits):
    key = F.struct(F.lit(0).alias("mask"), F.lit(7).cast("long").alias("seed")).alias("key")
    seeds = spark.range(items).select(F.col("id").alias("item"), F.lit(0).alias("item_pos"), key)
    rows = spark.range(hits).select(F.col("id").alias("row"), F.lit(0).alias("pos"), key)
    h, s = decontaminate._shared_out(rows, seeds)
    most = lambda df: df.groupBy("key", "i", "j").count().agg(F.max("count")).first()[0]
    # Parts dealt by hash are about even.
    assert most(h) <= 1.5 * decontaminate.MET_HITS and most(s) <= 1.5 * decontaminate.MET_ITEMS + 8
    n, different = h.join(s, ["key", "i", "j"]).agg(F.count("*"), F.count_distinct("row", "item")).first()
    assert n == different == items * hits


def test_equal_to_the_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decontaminate, "MET_ITEMS", 3)
    monkeypatch.setattr(decontaminate, "MET_HITS", 5)
    items, docs = _rows(40)
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark")
    spark.createDataFrame([d for d in docs if d != (3, "repeated row")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = connection("/root/testdata/sf0.001")
    for t in ("benchmark", "documents"):
        con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    name = next(k for k in ORACLES if k.startswith("op4_"))
    got = decontaminate.digest(spark.read.parquet(f"{tmp_path}/documents"), spark.read.parquet(f"{tmp_path}/benchmark"))
    rel = con.sql(ORACLES[name])
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall()) and got.count() == 41
