"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.storage import shared_dir

#: ASCII white space, the separator of words in every operator here.
SPACE = r"\x20\x09-\x0D"
#: The same six characters as a SQL string literal for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidewell-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_words(text: Column | str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null and blank texts."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.trim(F.coalesce(c, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_hash_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n: the fold of a document."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(c.cast("string"), "UTF-8")) % n


#: A key is hot with one of so many parts of all rows, and with at least so many rows.
HOT_PARTS, HOT_ROWS = 1000, 10_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, times: str, total: int) -> DataFrame:
    """rows joined with table on key; table has one row a key, and times in it is the number of rows that have it.

    Hot keys, of which there are at most HOT_PARTS, have their rows of the table broadcast, so that no task gets all
    rows of one key; the other keys are shuffled.
    """
    hot = f"{times} >= {max(HOT_ROWS, total // HOT_PARTS)}"
    few = F.broadcast(table.filter(hot))
    rest = rows.join(F.broadcast(table.filter(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(table.filter(f"NOT ({hot})"), key))


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], least: int = HOT_ROWS) -> DataFrame:
    """rows joined with table, which has one row a key; keys that many rows share are found by counting them.

    Keys of over one HOT_PARTS-th of all rows, so no more than HOT_PARTS keys, and of at least so many rows, have their
    row of the table broadcast; the others are shuffled.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_times"))
    total = counts.agg(F.coalesce(F.sum("_times"), F.lit(0)).alias("t"))
    hot = counts.filter(F.col("_times") >= F.greatest(F.lit(least), (total.scalar() / HOT_PARTS).cast("long"))).select(*keys)
    hot = written(table.join(hot, keys, "left_semi"), "hot")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(table, keys))
