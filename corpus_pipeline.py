"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that
is written as Parquet in the shared folder and reread as the next one's docs.

Defined results: null, empty and blank texts have no word, so the first stage rejects them; rows that repeat a doc_id
are judged one by one by the first stage, and then stay or go together; rows without doc_id pass near dedup and
decontamination, which name documents by it, and are packed like others; further columns are carried along, whatever
their names, up to the last stage; an empty table gives an empty one.  A text of any length is judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontaminate, packing, pii, quality_rules, simhash
from tidewell.llm.common import documents, table, written
from tidewell.llm.encoding import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others go too."""
    return quality_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it."""
    return packing.digest(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", best_fit_packing),
]

#: Near-duplicates, the fitted field and the tokenizer have no SQL form; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
