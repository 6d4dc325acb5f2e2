"""Files with one JSON object a line, under declared schemas; a malformed line is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXAMPLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("answers", T.ArrayType(T.StringType())),
    ]
)
RAW_QUESTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("answers", T.StructType([T.StructField("text", T.ArrayType(T.StringType()))])),
    ]
)
PREDICTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("output", T.StringType())])


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions with an order of lines: file name, then offset of the row in it."""
    rows = spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)
    return rows.select("id", "output", F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"))


def parse(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of lines (value)."""
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
