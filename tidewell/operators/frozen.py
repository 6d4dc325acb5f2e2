"""One hash of a whole set of lines, the same for any number of files.

Lines are numbered in the order of a key; LEAF neighbours make a leaf, the SHA-256 of their hashes one after another, and
FAN nodes a node of the next level, until one is left.  Any range can be checked by itself against its node, and no task
holds more than a node's hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import sum_before

LEAF = 64
FAN = 64
#: The root of no line at all: the hash of an empty text.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _up(nodes: DataFrame, fan: int) -> DataFrame:
    """(k, h) of the next level."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
    return nodes.groupBy(F.floor(F.col("k") / fan).alias("_up")).agg(F.sha2(joined, 256).alias("h")).select(F.col("_up").alias("k"), "h")


def leaves(lines: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(k, h) of the leaves over lines (pos, line), numbered by pos, which is distinct."""
    hashed = lines.select("pos", F.sha2("line", 256).alias("h"), F.lit(1).cast("long").alias("one"))
    return _up(sum_before(hashed, "one", "k").select("k", "h"), leaf)


def root(lines: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """One row (n, root) of lines (pos, line)."""
    n = lines.count()
    if not n:
        return lines.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(EMPTY).alias("root"))
    nodes, left = leaves(lines, leaf), -(-n // leaf)
    while left > 1:
        nodes, left = _up(nodes, fan), -(-left // fan)
    return nodes.select(F.lit(n).cast("long").alias("n"), F.col("h").alias("root"))


def differing(ours: DataFrame, theirs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(k) of the leaves in which two sets of lines differ, those that only one has included."""
    a, b = leaves(ours, leaf), leaves(theirs, leaf).withColumnRenamed("h", "other")
    return a.join(b, "k", "full").filter(~F.col("h").eqNullSafe(F.col("other"))).select("k")
