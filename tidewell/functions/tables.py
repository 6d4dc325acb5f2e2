"""Table functions for SQL.

``text_within(TABLE(blocked), budget)`` gives the documents of a byte budget.  ``blocked`` is a view of
operators.corpus.blocked: documents in blocks of positions, with the bytes before each block.  A part of the function is one
block, taken in the order of pos; blocks after the budget end at their first row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewell.operators.corpus import blocked


class TextWithin:
    """(pos, text, n_bytes, bytes_before) of rows (block, block_bytes_before, pos, text, first) within a budget of bytes: up to the
    document that reaches it, and the first document always."""

    def __init__(self):
        self.before = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or budget.value is None:
            raise ValueError("text_within takes a table and a constant budget")
        missing = {"block", "block_bytes_before", "pos", "text", "first"} - {f.name for f in rows.dataType.fields}
        if missing:
            raise ValueError(f"the table has no {', '.join(sorted(missing))}: make it with operators.corpus.blocked")
        schema = StructType([StructField("pos", LongType()), StructField("text", StringType()), StructField("n_bytes", LongType()), StructField("bytes_before", LongType())])
        # An expression of its own: rows that a join has dealt by block already would be left where they are, and adaptive
        # execution may spread those of one block over several tasks afterwards.
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("-block")], orderBy=[OrderingColumn("pos")])

    def eval(self, row, budget: int):
        if self.before is None:
            self.before = row["block_bytes_before"]
        if self.before >= budget and not row["first"]:
            raise SkipRestOfInputTableException("the budget is met")
        size = len((row["text"] or "").encode())
        yield row["pos"], row["text"], size, self.before
        self.before += size


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_within", F.udtf(TextWithin))


def text_within(docs: DataFrame, budget: int, view: str = "blocked_documents") -> DataFrame:
    """The documents (pos, text) of a byte budget, by the SQL function."""
    spark = docs.sparkSession
    register(spark)
    blocked(docs).createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM text_within(TABLE({view}), {int(budget)})")
