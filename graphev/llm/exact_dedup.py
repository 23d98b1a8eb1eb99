"""Exact dedup by skew-safe combining of whole contents.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. Three
aggregations follow each other: every task combines the copies it has read, salted digest groups
are merged (a digest's copies are dealt over ``salts`` reducers), and the salts' winners are
combined. Each of them has the whole normalised content among its keys next to the digest, so
contents, not digests, decide. Of a group, the row with the most code points in the original
text stays, then the smallest doc_id, null doc_ids last.

Rows find their group by its digest. Should one digest ever belong to two contents (this is looked
for each time), they find it by the digest and a second, unrelated hash of the content.

Null text counts as empty; empty texts are one group. Repeated rows are copies of each other; of
rows with equal doc_ids all carry ``kept`` if that doc_id stays. Extra columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphev.llm.common import BLANKS, saved, table

SALTS = 32
HALF, SPAN = Decimal(2**63), Decimal(2**65)


def squeezed(text: Column) -> Column:
    """text without blanks; byte searches are faster than a regular expression here."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def rank(n_chars: Column, doc_id: Column) -> Column:
    """A number that is larger for more code points, then for a smaller doc_id; null is last. A
    decimal, as Spark can update it in place in a hash aggregation."""
    after = F.when(doc_id.isNull(), F.lit(Decimal(0))).otherwise(F.lit(HALF) - doc_id.cast("decimal(19,0)"))
    return (n_chars.cast("decimal(10,0)") * F.lit(SPAN) + after).cast("decimal(38,0)")


def winner(r: Column) -> Column:
    after = r % F.lit(SPAN)
    return F.when(after > 0, (F.lit(HALF) - after).cast("long"))


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", squeezed(F.col("text")).alias("content"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("content", 256)))
    ranked = rows.select("doc_id", "digest", "content", rank(F.col("n_chars"), F.col("doc_id")).alias("r"))
    salted = ranked.withColumn("salt", F.spark_partition_id() % salts).groupBy("digest", "salt", "content").agg(F.max("r").alias("r"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", "content").agg(F.max("r").alias("r"), F.sum("n").alias("n"))
    groups = saved(whole.select("digest", F.xxhash64("content").alias("tag"), winner(F.col("r")).alias("keep_id"), F.col("n").alias("group_size")))
    twice = groups.groupBy("digest").agg(F.count("*").alias("k")).filter("k > 1")
    by = ["digest"] if twice.isEmpty() else ["digest", "tag"]
    light = rows.select("doc_id", "digest", *([F.xxhash64("content").alias("tag")] if "tag" in by else []))
    return light.join(groups, by).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
