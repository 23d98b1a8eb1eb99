"""Reproducible shuffle and sharding by a Feistel permutation over global row numbers.

Rows are numbered 0..n-1 in the order of their keys. A Feistel network permutes the smallest
power-of-two domain that holds n; a value outside 0..n-1 is permuted again until it falls
inside (cycle walking), which leaves a permutation of 0..n-1. The permuted number p gives
shard = p mod k and slot = p div k: both can be computed from the row number alone, shard sizes
differ by one row at most, and slots have no gaps.

Law: ``rows`` (counts at most one apart). Equal texts are not kept together: under this law a
group of copies larger than n/k could not be. Rows with equal sort keys are interchangeable in
the result. Null keys sort first; null text has no bytes (size 1, CRC 0). An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphev.llm.common import saved, shuffle_partitions

PRIME = 2147483647
#: Each walk leaves the domain's outer part with a chance over one half; a row that needs more
#: steps stops the job with an error, it is never misplaced.
MAX_WALK = 96
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    draw = random.Random(seed)
    return [tuple(draw.randrange(1, PRIME) for _ in range(3)) for _ in range(rounds)]


def half_bits(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def feistel(x: Column, n: int, seed: int) -> Column:
    """One pass of the network over 0..2^bits-1. In each round one half is changed by a keyed
    function of the other, so a round can be undone."""
    left, right = half_bits(n)
    rounds = F.array(
        *[
            F.struct(*[F.lit(v).cast("long").alias(name) for name, v in zip("abcuv", (*keys, *((2**left - 1, 0) if i % 2 else (0, 2**right - 1))))])
            for i, keys in enumerate(round_keys(seed))
        ]
    )

    def mixed(half: Column, k: Column) -> Column:
        t = (half + k["a"]) % PRIME
        return ((t * t) % PRIME * k["b"] + k["c"]) % PRIME

    def one(s: Column, k: Column) -> Column:
        return F.struct(
            s["l"].bitwiseXOR(mixed(s["r"], k).bitwiseAND(k["u"])).alias("l"),
            s["r"].bitwiseXOR(mixed(s["l"], k).bitwiseAND(k["v"])).alias("r"),
        )

    start = F.struct(F.shiftright(x, right).alias("l"), x.bitwiseAND(F.lit(2**right - 1).cast("long")).alias("r"))
    return F.aggregate(rounds, start, one, lambda s: F.shiftleft(s["l"], right).bitwiseOR(s["r"]))


def permuted(x: Column, n: int, seed: int) -> Column:
    """The place of row x of n after the shuffle."""
    walk = F.aggregate(
        F.sequence(F.lit(2), F.lit(MAX_WALK)), feistel(x, n, seed), lambda p, _: F.when(p < n, p).otherwise(feistel(p, n, seed))
    )
    return F.transform(F.array(walk), lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))[0]


def numbered(df: DataFrame, keys: list[str], to: str = "row_no") -> tuple[DataFrame, int]:
    """df with gapless row numbers from 0 in the order of keys, and the number of rows.

    A range shuffle, a sort inside partitions, and the offsets of the partitions from one small
    table of their counts; no task sees more than its own range. The scan's own row id is the
    last range key, so that a third of all rows with one key still spreads."""
    n = shuffle_partitions(df.sparkSession)
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *keys, "_tie")
        .sortWithinPartitions(*keys, "_tie")
        .drop("_tie")
    )
    kept = saved(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    # one row for each shuffle partition
    offsets = F.broadcast(counts.select("_part", "_before"))
    inner = F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    return kept.withColumn("_part", part).join(offsets, "_part").withColumn(to, F.col("_before") + inner).drop("_part", "_before", "_at"), total


def feistel_shards(docs: DataFrame, shards: int = 8, seed: int = 20240601) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, row_no, shard, slot."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    place = rows.withColumn("_p", permuted(F.col("row_no"), max(n, 1), seed))
    return place.select(
        "doc_id", "size", "text_crc32", "row_no", (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot")
    )


def op2_feistel_shards(spark, sf_dir: str) -> DataFrame:
    from graphev.llm.common import table

    out = feistel_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
