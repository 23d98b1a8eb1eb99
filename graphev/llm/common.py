"""Small helpers shared by the text operators: tables and text keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphev.functions.shared import new_dir, saved, shared_dir

__all__ = ["BLANKS", "LOWER", "UPPER", "ascii_lower", "hash128", "new_dir", "saved", "shared_dir", "shuffle_partitions", "table"]

#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() is far faster than translate() and does the
    same where every character is one byte."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hash128(*c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the same values that differ in their seed."""
    return F.xxhash64(*c), F.xxhash64(F.lit(1), *c)
