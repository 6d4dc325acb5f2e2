"""The pipeline against the stages done by hand on a small table."""

from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline
from tests.conftest import SF, SMALL
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_ids
from tidewell.llm import decontaminate, pii, quality_rules
from tidewell.llm.common import written


def test_stages_and_columns(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), "test")
        assert docs.columns == names


def test_run_equals_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality(docs).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", quality_rules.clean_text(docs.text).alias("text")).collect() if r.doc_id in kept}
    own = brute_components({i: brute_fingerprint(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if own[i] == i}
    left = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    leaks = {r.doc_id for r in decontaminate.digest(left, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    left = left.filter(~left.doc_id.isin(sorted(leaks)))
    field = pii.fitted(left)
    texts = {i: pii.redact(t, pii.all_spans(t, pii.base_spans(t), field)) for i, t in texts.items() if i not in leaks}
    want = {}
    for (i, _), ids in zip(sorted(texts.items()), brute_ids([t for _, t in sorted(texts.items())]), strict=True):
        ids = np.append(ids, 0).astype("<u4")
        want |= {(i, k // 2048): (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want


def test_good_documents_come_through(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stayed = corpus_pipeline.quality(spark, docs, SF).join(labels, "doc_id").count()
    assert stayed > 0.9 * docs.join(labels, "doc_id").count()
