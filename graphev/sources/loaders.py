"""Graph loaders: objects and edges from CSV and JSON files (A2-A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def filled(c: str, columns: list[str], default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(default)) if c in columns else F.lit(default)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def load_objects_csv(spark: SparkSession, path: str, type_name: str = "Object") -> DataFrame:
    """name, type_name, metadata (map). Rows need a name. metadata is the JSON of that column (bad
    JSON: nothing) together with every other column that has a value."""
    rows = read_csv(spark, path)
    known = ("name", "type_name", "metadata")
    others = [c for c in rows.columns if c not in known]
    given = F.from_json("metadata", "map<string,string>") if "metadata" in rows.columns else F.lit(None).cast("map<string,string>")
    folded = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*[F.col(f"`{c}`") for c in others])), lambda _, v: v.isNotNull()) if others else F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(folded), k))
    return rows.filter("trim(name) <> ''").select("name", filled("type_name", rows.columns, type_name).alias("type_name"), F.map_concat(own, folded).alias("metadata"))


def load_morphisms_csv(spark: SparkSession, path: str) -> DataFrame:
    """name, source_name, target_name, confidence; incomplete rows go, a missing or malformed
    confidence is 1."""
    rows = read_csv(spark, path).filter("trim(name) <> '' and trim(source_name) <> '' and trim(target_name) <> ''")
    confidence = F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(1.0)) if "confidence" in rows.columns else F.lit(1.0)
    return rows.select("name", "source_name", "target_name", confidence.alias("confidence"))


def load_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Objects and edges of files {"objects": [...], "morphisms": [...]}; incomplete ones go."""
    kind = "objects array<struct<name:string,type_name:string>>, morphisms array<struct<name:string,source:string,target:string,confidence:double>>"
    whole = spark.read.schema(kind).option("multiLine", True).json(path)
    objects = whole.select(F.inline("objects")).filter("name is not null").select("name", F.coalesce("type_name", F.lit("Object")).alias("type_name"))
    edges = whole.select(F.inline("morphisms")).filter("name is not null and source is not null and target is not null")
    return objects, edges.select("name", F.col("source").alias("source_name"), F.col("target").alias("target_name"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
