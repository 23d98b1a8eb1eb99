"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphev.functions.shared import ship
from graphev.llm.common import new_dir, table
from graphev.llm.decontaminate import contaminated
from graphev.llm.line_dedup import dedup_lines
from graphev.llm.packing import pack
from graphev.llm.simhash_dedup import drop_near_copies, text_class
from graphev.llm.toxicity import scored


def _aside(docs: DataFrame) -> dict[str, str]:
    """Other names for the columns that operators do not read, so that none clashes with their own."""
    return {c: f"_in{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.withColumnsRenamed({new: old for old, new in _aside(docs).items()}).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    ship(spark)
    return _back(scored(docs.withColumnsRenamed(_aside(docs)), table(spark, sf_dir, "labels")).filter("predicted = 0").drop("score", "held_out", "predicted"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their text without the lines that stay elsewhere; n_chars follows the text."""
    out = _back(dedup_lines(docs.withColumnsRenamed(_aside(docs))).drop("n_lines", "n_dropped"), docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Hits are told by doc_id and text, as documents may
    share a doc_id or have none."""
    key = F.struct("doc_id", text_class(F.col("text")).alias("class"))
    hits = contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select("doc_id.*").distinct()
    hits = hits.withColumnsRenamed({"doc_id": "_hit", "class": "_class"})
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("_hit")) & (text_class(F.col("text")) == F.col("_class")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in full windows, one row per piece."""
    ship(spark)
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: The network of the first stage and the tokenizer of the last cannot be put in SQL; the stages
#: are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
