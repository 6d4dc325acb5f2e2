"""Strict JSON tests as column expressions.

Spark's parsers accept text after the first value and other laxities.  A text counts as JSON here only if it
is one value inside an array and the one value of an object: trailing text can satisfy either wrap but not both.
As in Python's parser, the last of repeated keys counts, which needs take_last_key on the session, and NaN, Infinity and
-Infinity are numbers: plain() puts a number in their place.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A literal that is no number of JSON proper, by itself and outside of strings: what follows it holds whole strings only.
NO_NUMBER = r'(?<![\w.+-])(?:-?Infinity|NaN)(?![\w.])(?=(?:[^"\\]|\\.|"(?:[^"\\]|\\.)*")*+$)'


def take_last_key(spark: SparkSession) -> None:
    """Lets the session's JSON parser take the last of repeated keys; it refuses such objects otherwise."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def plain(raw: Column) -> Column:
    """The text with 0 for each literal that is no number of JSON proper."""
    return F.when(raw.contains("NaN") | raw.contains("Infinity"), F.regexp_replace(raw, NO_NUMBER, "0")).otherwise(raw)


def is_json(raw: Column) -> Column:
    in_array = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"r":'), raw, F.lit("}")))
    one = F.size(F.try_variant_get(in_array, "$", "array<variant>")) == 1
    only = F.map_keys(F.try_variant_get(in_object, "$", "map<string,variant>")) == F.array(F.lit("r"))
    return F.coalesce(one & only, F.lit(False))


def field_type(raw: Column, field: str) -> Column:
    """The type of an object's field as Spark names it; null if it is absent."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), f"$.{field}", "variant"))


def field_text(raw: Column, field: str) -> Column:
    return F.try_variant_get(F.try_parse_json(raw), f"$.{field}", "string")


def keys(raw: Column) -> Column:
    """Sorted distinct keys of an object; null for other values."""
    return F.array_sort(F.array_distinct(F.json_object_keys(raw)))
