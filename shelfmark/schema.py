"""Schemas of the inventory and of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("file", T.StringType(), False),
        T.StructField("line", T.IntegerType(), False),
        T.StructField("signature", T.StringType(), False),
        T.StructField("docstring", T.StringType(), False),
        T.StructField("lang", T.StringType(), False),
        T.StructField("qualname", T.StringType(), False),
        T.StructField("seq", T.IntegerType(), False),
    ]
)
FIELDS = ["name", "file", "line", "signature", "docstring", "lang", "qualname"]
SHAPE = T.StructType([T.StructField("params", T.ArrayType(T.StringType())), T.StructField("returns", T.StringType()), T.StructField("has_return_hint", T.BooleanType())])
SOURCE = "path string, content string"
SNAPSHOT = "path string, mtime_ns bigint, size bigint"
#: Version of the stored index, and of the documents the commands emit.
SCHEMA_VERSION = 1


def records(df: DataFrame) -> DataFrame:
    """Any table with the record's columns as an inventory: absent text is '', unknown columns are dropped, seq is 0 where it lacks."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in FIELDS if c != "line"]
    seq = F.coalesce(F.col("seq"), F.lit(0)).cast("int") if "seq" in df.columns else F.lit(0)
    return df.select(*text, F.col("line").cast("int").alias("line"), seq.alias("seq")).select(*FIELDS, "seq")


def display_name(prefix: str = "") -> "F.Column":
    """The qualified name, or the name where that is empty."""
    return F.when(F.col(f"{prefix}qualname") != "", F.col(f"{prefix}qualname")).otherwise(F.col(f"{prefix}name"))
