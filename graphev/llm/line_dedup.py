"""Line dedup over levelled sorted runs of line hashes.

Each document is split at newlines. A line's key is the line without [\\x20\\x09-\\x0D] at its
ends and with A-Z lower-cased. A key of at least ``min_chars`` code points that is found in at
least ``min_docs`` documents loses all its lines but those in the largest doc_id that holds it.

The documents arrive in batches; those of one table are dealt by falling doc_id, so that a known key
never has a new owner. A batch's distinct keys form a sorted run. The batch is merge-anti-joined with
the runs so far: keys that no run knows with as large an owner come in with theirs (their largest
doc_id), other keys add only a count. When ``fanout`` runs stand on a level,
they are compacted into one run of the next level. All runs are hash-partitioned and sorted by
key in the same way, so these joins merge without a shuffle; writing a compacted run takes one.
Text is never in a run: rows hold two 64-bit hashes of a key.

Null text counts as one empty line. Every row is a document, rows that repeat a doc_id too; where
the largest doc_id repeats, all its rows keep the line. Rows without a doc_id count as documents
but are never the largest and lose no line. Lines that are equal inside a document count once for it and are
lost or kept together. Where all lines go, the text is empty. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphev.llm.common import BLANKS, ascii_lower, hash128, saved, shuffle_partitions, table

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 2
KEY = ["h1", "h2"]
#: Parts of a key when rows meet its owner.
SALTS = 16


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Rows with equal keys have equal doc_ids and texts, and so the same result."""
    return [c.alias(f"r{i}") for i, c in enumerate(hash128(doc_id, text))]


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line that is long enough: its row's key, position, hashes, and whether it
    is the first of its kind in the document."""
    trimmed = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(F.btrim(x, F.lit(BLANKS)).alias("s"), i.alias("pos")))
    long = F.filter(trimmed, lambda x: F.char_length(x["s"]) >= min_chars)

    def hashed(x: Column) -> Column:
        one, two = hash128(ascii_lower(x["s"]))
        return F.struct(one.alias("h1"), two.alias("h2"), x["pos"].alias("pos"))

    keys = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.array_sort(F.transform(long, hashed)).alias("k"))
    first = F.transform(
        "k",
        lambda x, i: F.struct(
            x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"),
            ((i == 0) | (F.get("k", i - 1)["h1"] != x["h1"]) | (F.get("k", i - 1)["h2"] != x["h2"])).alias("first"),
        ),
    )
    return keys.select("doc_id", "r0", "r1", F.inline(first))


def saved_run(df: DataFrame) -> DataFrame:
    """df as a sorted run in the shared folder. Spark remembers a checkpoint's partitioning and
    order only where its plan is not adaptive; the rows are distinct keys, so none is hot."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return saved(df.repartition(shuffle_partitions(spark), *KEY).sortWithinPartitions(*KEY))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def compacted(runs: list[DataFrame]) -> DataFrame:
    """One run of several, by merging them in pairs."""
    every = runs[0]
    for run in runs[1:]:
        joined = every.alias("a").join(run.alias("b"), KEY, "full_outer")
        every = joined.select(
            *KEY, (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"), F.greatest("a.owner", "b.owner").alias("owner")
        )
    return every


def add_batch(levels: list[list[DataFrame]], new: DataFrame, fanout: int) -> list[list[DataFrame]]:
    """The runs after a batch. levels: the runs so far, by level; new: the batch's distinct keys (h1,
    h2, n, owner), of documents in any order of doc_id. Keys that no run knows with an owner as large
    keep theirs, the others only add to the count. Runs may come from earlier jobs, as they are plain
    tables; those of saved_run merge without a shuffle."""
    known = [run for level in levels for run in level]
    fresh = new
    for run in known:
        as_large = F.col("run.owner") >= F.col("new.owner")
        fresh = fresh.alias("new").join(run.alias("run"), (F.col("new.h1") == F.col("run.h1")) & (F.col("new.h2") == F.col("run.h2")) & as_large, "left_anti")
    if known:
        marked = new.join(fresh.select(*KEY, F.lit(True).alias("fresh")), KEY, "left")
        new = marked.select(*KEY, "n", F.when(F.col("fresh"), F.col("owner")).alias("owner"))
    levels = [list(level) for level in levels] or [[]]
    levels[0].append(new)
    at = 0
    while len(levels[at]) >= fanout:
        if at + 1 == len(levels):
            levels.append([])
        levels[at + 1].append(saved_run(compacted(levels[at])))
        levels[at] = []
        at += 1
    return levels


def all_keys(levels: list[list[DataFrame]]) -> DataFrame:
    """h1, h2, n, owner of every key in the runs."""
    return compacted([run for level in levels for run in level])


def key_runs(rows: DataFrame, batches: int, fanout: int) -> DataFrame:
    """All keys with their number of documents and their owner."""
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    # batch 0 holds the largest doc_ids, the last batch the null ones
    batch = F.lit(len(set(cuts)))
    for i, cut in enumerate(sorted(set(cuts))):
        batch = F.when(F.col("doc_id") > cut, F.least(batch, F.lit(len(set(cuts)) - 1 - i))).otherwise(batch)
    grouped = rows.withColumn("batch", batch).groupBy("batch", *KEY).agg(F.sum(F.col("first").cast("long")).alias("n"), F.max("doc_id").alias("owner"))
    arrived = saved_run(grouped)
    levels: list[list[DataFrame]] = []
    for b in range(len(set(cuts)) + 1):
        levels = add_batch(levels, arrived.filter(F.col("batch") == b).select(*KEY, "n", "owner"), fanout)
    return all_keys(levels)


def lost_lines(rows: DataFrame, common: DataFrame) -> DataFrame:
    """(r0, r1, _lost): the positions of the lines that a document loses. A line that very many
    documents hold is one key, so rows are dealt over SALTS parts of a key, and each part gets the
    key's owner."""
    owners = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = rows.withColumn("salt", F.pmod("r0", F.lit(SALTS)).cast("int")).join(owners, [*KEY, "salt"])
    return found.filter(F.col("doc_id") != F.col("owner")).groupBy("r0", "r1").agg(F.collect_set("pos").alias("_lost"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_lines and n_dropped (long)."""
    rows = saved(line_rows(docs, min_chars))
    common = key_runs(rows, batches, fanout).filter(F.col("n") >= min_docs).select(*KEY, "owner")
    lost = lost_lines(rows, common)
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")], *row_key(F.col("doc_id"), F.col("text")))
    lines = lines_of(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), "_lost")
    kept = F.when(F.col("_lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("_l", i)), "\n"))
    return (
        out.join(lost, ["r0", "r1"], "left")
        .withColumn("_l", lines)
        .withColumns({"text": kept, "n_lines": F.size("_l").cast("long"), "n_dropped": F.coalesce(F.size("_lost"), F.lit(0)).cast("long")})
        .drop("r0", "r1", "_l", "_lost")
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
