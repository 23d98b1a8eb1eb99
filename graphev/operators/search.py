"""Full-text search over records: a positional inverted index as a table, AND queries ranked by BM25, and
snippets.

Words are stretches of [A-Za-z0-9], compared lower-cased. Many queries are asked at once: they meet the
index by word, and only records with all of a query's words are ranked. Texts are read again only for
the records that are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphev.functions.shared import saved

K1, B, LIMIT, SNIPPET = 1.2, 0.75, 20, 24


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))


def postings(records: DataFrame) -> DataFrame:
    """records (id, body) -> (word, id, tf, places, length): a row per word of a record, its places from
    0 in order, and the record's number of words."""
    rows = records.select("id", words(F.col("body")).alias("w"))
    each = rows.select("id", F.size("w").alias("length"), F.posexplode("w").alias("place", "word")).withColumn("word", F.lower("word"))
    return each.groupBy("word", "id", "length").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("place")).alias("places"))


def search(index: DataFrame, records: DataFrame, queries: DataFrame, limit: int = LIMIT, width: int = SNIPPET) -> DataFrame:
    """index of postings(), records (id, body), queries (query, text) -> query, id, k, score, snippet: the
    ``limit`` best records with all words of a query, ties by id. Queries without words find nothing; a
    word that is given twice counts once. The average length is over records that have words.

    The snippet is the ``width`` words from a match on that hold most of the query's words, then most
    matches, the first such; matches stand in brackets, dots say that the text goes on."""
    asked = queries.select("query", F.array_distinct(F.transform(words(F.col("text")), F.lower)).alias("w")).filter("size(w) > 0")
    asked = saved(asked.select("query", F.size("w").alias("n"), F.explode("w").alias("word")))
    size = index.select("id", "length").distinct().agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    used = index.join(asked.select("word").distinct(), "word", "left_semi")
    df = used.groupBy("word").agg(F.count("*").alias("df"))
    rows = used.join(df, "word").crossJoin(F.broadcast(size))  # one row is broadcast
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hit = asked.join(rows.select("word", "id", part.alias("part")), "word").groupBy("query", "id", "n").agg(F.count("*").alias("found"), F.round(F.sum("part"), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    best = saved(hit.filter("found = n").withColumn("k", rank).filter(F.col("k") <= limit).select("query", "id", "k", "score"))

    said = best.join(asked, "query").join(used.select("word", "id", "places"), ["word", "id"])
    at = said.select("query", "id", F.explode("places").alias("place"), "word").groupBy("query", "id").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("m"))
    inside = lambda s: F.filter("m", lambda x: (x["place"] >= s["place"]) & (x["place"] < s["place"] + width))
    value = lambda s: F.struct((-F.size(F.array_distinct(F.transform(inside(s), lambda x: x["word"])))).alias("kinds"), (-F.size(inside(s))).alias("all"), s["place"].alias("start"))
    shown = at.withColumn("start", F.array_min(F.transform("m", value))["start"])
    shown = shown.join(records.join(best.select("id").distinct(), "id", "left_semi").select("id", words(F.col("body")).alias("w")), "id")
    marked = F.transform(F.slice("w", F.col("start") + 1, width), lambda x, i: F.when(F.exists("m", lambda y: y["place"] == F.col("start") + i), F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    snippet = F.concat(F.when(F.col("start") > 0, F.lit("...")).otherwise(""), F.array_join(marked, " "), F.when(F.col("start") + width < F.size("w"), F.lit("...")).otherwise(""))
    return best.join(shown.select("query", "id", snippet.alias("snippet")), ["query", "id"]).select("query", "id", "k", "score", "snippet")
