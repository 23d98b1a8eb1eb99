"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

Texts are lower-cased and cut into words of letters and digits. For an item of L words, the
windows of a document are its runs of L words (the whole document, if shorter). A window and an
item are alike if the similarity of their word shingles, weighted by how often they occur
(sum of minima over sum of maxima), is ``SIMILARITY`` or more; shingles have five words, fewer
for items with fewer words.

1. Only windows that share a shingle with the item can be alike. A Bloom filter over all items'
   shingles finds the places where a document may hold one, while it is read; documents without
   such a place go no further. An exact join with the shingles then leaves no false places.
2. The windows over these places get a 64-bit SimHash of their words. Fingerprints are cut into 4
   blocks of 16 bits. Two of them within RADIUS = 15 bits differ in at most 3 bits in some block,
   so items are filed under every block value up to 3 flips away and windows look theirs up:
   all pairs within the radius meet. Equal fingerprints are looked up once.
3. The pairs within the radius are verified by the exact similarity.

Null and empty texts and items without words match nothing. Items may repeat. A document that is
in the table twice yields the same hits once per doc_id. Null ids are kept in the hits. Extra
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphev.llm.common import saved, table

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, FLIPS = 4, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: The Bloom filter's bits for each item shingle, so that one place in a million passes by chance,
#: and the most it may have; past that it lets more through, and the join after it drops them.
BLOOM_BITS, BLOOM_MOST = 64, 1 << 24
#: A key's places in the filter are its bits from here on.
PROBES = (0, 10, 20, 30, 40)


def let(value: Column, f) -> Column:
    """f(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_hashes(text: str) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(h: Column, k: int) -> Column:
    """Hashes of the runs of k words; empty if there are fewer words."""
    at = F.when(F.size(h) >= k, F.sequence(F.lit(0), F.size(h) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + j) for j in range(k)]))


def simhash(h: Column, lanes: int) -> Column:
    """SimHash of word hashes. Counts of bits are kept in lanes of 8, 16 or 32 bits of a long."""
    unit = sum(1 << (lanes * j) for j in range(64 // lanes))
    zero = F.array_repeat(F.lit(0).cast("long"), lanes)
    add = lambda acc, x: F.transform(acc, lambda a, k: a + F.call_function("shiftrightunsigned", x, k).bitwiseAND(F.lit(unit)))

    def bits(acc: Column) -> Column:
        def bit(out: Column, b: Column) -> Column:
            count = F.call_function("shiftrightunsigned", F.get(acc, b % lanes), ((b / lanes).cast("int") * lanes)).bitwiseAND(F.lit((1 << lanes) - 1))
            return F.when(count * 2 > F.size(h), out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(out)

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)

    return let(F.aggregate(h, zero, add), bits)


def counted(s: Column) -> Column:
    """Each shingle together with its number among its equals: a set with the multiset's size."""
    return let(F.array_sort(s), lambda t: F.transform(t, lambda x, i: F.xxhash64(x, i - F.array_position(t, x).cast("int"))))


def bloom(keys: DataFrame, bits: int) -> Column:
    """The filter as an array literal; BLOOM_MOST bounds it to 2 MB. keys: s."""
    places = keys.select(F.explode(F.array(*[F.shiftrightunsigned("s", n).bitwiseAND(F.lit(bits - 1)) for n in PROBES])).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63L as int))")).alias("v"))
    out = np.zeros(bits // 64, np.int64)
    for w, v in words.collect():
        out[w] = v
    return F.lit(out)


def maybe_in(b: Column, s: Column, bits: int) -> Column:
    out = None
    for n in PROBES:
        p = F.shiftrightunsigned(s, n).bitwiseAND(F.lit(bits - 1))
        hit = F.call_function("shiftrightunsigned", F.get(b, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        out = hit if out is None else out & hit
    return out


def filed(df: DataFrame, flips: int) -> DataFrame:
    """df (size, fp, ...) with a row for each key (size, block, value) of its fingerprint."""
    masks = [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(16), n)]
    df = df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    own = F.expr("shiftrightunsigned(fp, 16 * block) & 65535L")
    if flips == 0:
        return df.withColumn("value", own)
    return df.withColumn("mask", F.explode(F.lit(masks))).withColumn("value", own.bitwiseXOR(F.col("mask").cast("long"))).drop("mask")


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. The best window of each document and item that
    are alike: doc_id, item_id, start_word, n_words, hamming, similarity."""
    items = items.select("item_id", word_hashes("text").alias("h")).filter(F.size("h") > 0)
    items = items.select("item_id", F.monotonically_increasing_id().alias("item"), "h", F.size("h").alias("size"), F.least(F.size("h"), F.lit(SHINGLE)).alias("k"))
    items = saved(items)
    facts = items.agg(F.collect_set("k"), F.max("size"), F.sum(F.col("size") - F.col("k") + 1)).first()
    ks, largest, n = sorted(facts[0]), facts[1] or 1, facts[2] or 0
    lanes = 8 if largest < 256 else 16 if largest < 65536 else 32
    of_k = lambda h: F.coalesce(*[F.when(F.col("k") == k, shingles(h, k)) for k in ks]) if ks else F.array().cast("array<long>")
    items = saved(items.withColumn("s", of_k(F.col("h"))))
    keys = saved(items.select("size", "k", F.explode("s").alias("s")).distinct())
    bits = min(BLOOM_MOST, max(1 << 16, 1 << (BLOOM_BITS * n).bit_length()))

    marks = bloom(keys, bits)

    def places(h: Column) -> Column:
        each = [F.transform(shingles(h, k), lambda s, i: F.struct(i.alias("pos"), s.alias("s"))) for k in ks]
        return F.filter(F.concat(*each), lambda x: maybe_in(marks, x["s"], bits))

    empty = F.array().cast("array<struct<pos:int,s:bigint>>")
    found = docs.select("doc_id", word_hashes("text").alias("h"))
    found = found.select("doc_id", let(F.col("h"), lambda h: F.struct(h.alias("h"), (places(h) if ks else empty).alias("at"))).alias("x"))
    found = found.select("doc_id", "x.h", "x.at").filter(F.size("at") > 0)
    found = saved(found.withColumn("row", F.monotonically_increasing_id()))

    hits = found.select("row", F.size("h").alias("n"), F.explode("at").alias("x")).select("row", "n", "x.pos", "x.s").join(keys, "s")
    first = F.greatest(F.lit(0), F.least(F.col("pos") + F.col("k") - F.col("size"), F.col("n") - F.col("size")))
    last = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("n") - F.col("size")))
    wins = hits.select("row", "size", F.explode(F.sequence(first, last)).alias("start")).distinct()
    # a document's windows, bounded by its own length, meet its words in one row
    per_row = wins.groupBy("row").agg(F.collect_list(F.struct("size", "start")).alias("w")).join(found.select("row", "h"), "row")
    cut = per_row.select("row", F.explode(F.transform("w", lambda w: F.struct(w["size"].alias("size"), w["start"].alias("start"), F.slice(F.col("h"), w["start"] + 1, w["size"]).alias("h")))).alias("x"))
    wins = saved(cut.select("row", "x.size", "x.start", simhash(F.col("x.h"), lanes).alias("fp")))

    index = filed(items.select("item", "size", simhash(F.col("h"), lanes).alias("fp")), FLIPS).withColumnRenamed("fp", "item_fp")
    # the index has thousands of rows for an item: it is merged, never broadcast
    near = filed(wins.select("size", "fp").distinct(), 0).join(index.hint("merge"), ["size", "block", "value"])
    near = near.withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).filter(F.col("hamming") <= RADIUS)
    near = near.select("size", "fp", "item", "hamming").distinct()

    pairs = wins.join(near, ["size", "fp"]).groupBy("row").agg(F.collect_list(F.struct("item", "size", "start", "hamming")).alias("w"))
    pairs = pairs.join(found, "row").select("row", "doc_id", F.explode(F.transform("w", lambda w: F.struct(w.alias("w"), F.slice(F.col("h"), w["start"] + 1, w["size"]).alias("h")))).alias("x"))
    pairs = pairs.select("row", "doc_id", "x.w.*", F.col("x.h").alias("win"))
    pairs = pairs.join(items.select("item", "item_id", "k", counted(F.col("s")).alias("b")), "item")
    mine = F.coalesce(*[F.when(F.col("k") == k, counted(shingles(F.col("win"), k))) for k in ks]) if ks else F.array().cast("array<long>")
    pairs = pairs.withColumn("a", mine).withColumn("both", F.size(F.array_intersect("a", "b")))
    pairs = pairs.withColumn("similarity", F.col("both") / (F.size("a") + F.size("b") - F.col("both"))).filter(F.col("similarity") >= similarity)
    best = F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start")).alias("s"), F.size("win").alias("n"))
    out = pairs.groupBy("doc_id", "item_id").agg(F.max(best).alias("x"))
    return out.select("doc_id", "item_id", (-F.col("x.s")).alias("start_word"), F.col("x.n").alias("n_words"), (-F.col("x.h")).cast("int").alias("hamming"), "x.similarity")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
