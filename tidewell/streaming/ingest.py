"""Streaming ingest: documents arrive file by file, are sized, and fill chunks across micro-batches.

The fill is three numbers: the chunk that is open, what it holds, and what went to validation.  They are kept,
with the batch that left them, in a one-row table beside the output, so a batch that is run again starts from
the same numbers and replaces its own output.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tidewell.operators import fill

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@dataclass
class Fill:
    batch: int = -1
    chunk_id: int = 0
    held: int = 0
    val_written: int = 0


def read_documents(spark: SparkSession, path: str, files_per_batch: int = 1, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def _state(spark: SparkSession, path: str, batch: int) -> Fill:
    """The fill that the last batch before this one left."""
    try:
        rows = spark.read.schema("batch long, chunk_id long, held long, val_written long").parquet(f"{path}/state")
    except AnalysisException as e:  # the first batch finds no table
        if e.getCondition() == "PATH_NOT_FOUND":
            return Fill()
        raise
    last = rows.select("batch", "chunk_id", "held", "val_written").filter(F.col("batch") < batch).orderBy(F.desc("batch")).first()
    return Fill(*last) if last else Fill()


def chunk_batch(docs: DataFrame, batch: int, path: str, flush_every: int, val_tokens: int) -> None:
    """Routes one micro-batch: whole documents, in the order of doc_id, with n_tokens = bytes + 1.

    Only (pos, n_tokens) are moved, in blocks of positions; one task orders the batch's chunks, never its rows.
    """
    spark = docs.sparkSession
    before = _state(spark, path, batch)
    sized = docs.select(F.col("doc_id").alias("pos"), (F.octet_length("text") + 1).cast("long").alias("n_tokens"))
    filled = fill.chunk_ids(sized, flush_every, before.held, before.chunk_id)
    held = F.sum("n_tokens") + F.when(F.col("chunk_id") == before.chunk_id, before.held).otherwise(0)
    each = filled.groupBy("chunk_id").agg(held.alias("h")).withColumn("closes", F.col("h") >= flush_every)
    earlier = Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("v", F.lit(before.val_written) + F.coalesce(F.sum("h").over(earlier), F.lit(0)))
    # Chunks after the first of training add nothing to validation.
    to_val = F.when(F.col("v") < val_tokens, F.col("h")).otherwise(0)
    each = each.withColumn("v", F.lit(before.val_written) + F.coalesce(F.sum(to_val).over(earlier), F.lit(0)))
    filled.join(each, "chunk_id").select("pos", "n_tokens", "chunk_id", "closes", "h", "v").write.mode("overwrite").parquet(f"{path}/chunks/batch={batch}")
    written = spark.read.schema("chunk_id long, closes boolean, h long, v long").parquet(f"{path}/chunks/batch={batch}")
    last = written.agg(F.max_by(F.struct("chunk_id", "closes", "h", "v"), "chunk_id").alias("last")).first().last
    after = replace(before, batch=batch)
    if last is not None:
        val = last.v + (last.h if last.closes and last.v < val_tokens else 0)
        after = Fill(batch, last.chunk_id + last.closes, 0 if last.closes else last.h, val)
    state = spark.createDataFrame([astuple(after)], "batch long, chunk_id long, held long, val_written long")
    state.write.mode("overwrite").parquet(f"{path}/state/b={batch}")


def start(docs: DataFrame, path: str, checkpoint: str, flush_every: int, val_tokens: int) -> StreamingQuery:
    """Takes all that is there now, in micro-batches, and stops."""
    run = lambda df, batch: chunk_batch(df, batch, path, flush_every, val_tokens)
    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunks(spark: SparkSession, path: str, val_tokens: int) -> DataFrame:
    """(chunk_id, n_docs, n_tokens, split) of what was written; a chunk that is still open goes to training."""
    rows = spark.read.parquet(f"{path}/chunks")
    whole = rows.groupBy("chunk_id").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.bool_or("closes").alias("full"), F.min("v").alias("before"))
    return whole.select("chunk_id", "n_docs", "n_tokens", F.when(F.col("full") & (F.col("before") < val_tokens), "val").otherwise("train").alias("split"))
