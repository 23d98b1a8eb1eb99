"""Bibliographic records as JSON lines (A5-A8) and signed networks as tab-separated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the public record format: what stands before an id.
ID_PREFIX = "https://openalex.org/"
WORK = """id string, title string, display_name string, publication_year int, abstract_inverted_index map<string, array<int>>,
authorships array<struct<author: struct<display_name: string>>>, concepts array<struct<display_name: string>>, referenced_works array<string>"""
CONCEPT = "id string, display_name string, description string, level int, ancestors array<struct<id: string>>, related_concepts array<struct<id: string>>"


def _id(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit(ID_PREFIX), F.lit(""))


def _given(items: Column) -> Column:
    """The items that are neither null nor empty; none for a null list."""
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def text_of_index(index: Column) -> Column:
    """A map of words to their positions -> the words in order, joined by spaces; null or empty: null."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))))
    return F.when(F.size(index) > 0, F.array_join(F.transform(F.array_sort(places), lambda p: p["word"]), " "))


def load_works(spark: SparkSession, path: str, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """A5: id, title, abstract, year, authors, concepts, citations. Lines that are no JSON go; a
    title falls back to the display name, then to the id; works without a year pass the bounds."""
    rows = spark.read.schema(WORK + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.filter(F.col("_bad").isNull())
    year = F.coalesce("publication_year", F.lit(0))
    for bound, meets in ((year_min, year >= (year_min or 0)), (year_max, year <= (year_max or 0))):
        if bound:
            rows = rows.filter((year == 0) | meets)
    key = _id(F.col("id"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("display_name", F.lit("")), key)
    return rows.select(
        key.alias("id"), title.alias("title"), text_of_index(F.col("abstract_inverted_index")).alias("abstract"), F.col("publication_year").alias("year"),
        _given(F.col("authorships.author.display_name")).alias("authors"), _given(F.col("concepts.display_name")).alias("concepts"),
        F.transform(_given(F.col("referenced_works")), _id).alias("citations"),
    )


def load_concepts(spark: SparkSession, path: str, min_level: int = 0, max_level: int = 5) -> DataFrame:
    """Id, name, description, level (none: 0), parent_ids, related_ids of the levels asked for."""
    rows = spark.read.schema(CONCEPT + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).filter(F.col("_bad").isNull())
    level = F.coalesce("level", F.lit(0))
    ids = lambda c: _given(F.transform(F.coalesce(c, F.array().cast("array<string>")), _id))
    key = _id(F.col("id"))
    return rows.filter(level.between(min_level, max_level)).select(
        key.alias("id"), F.coalesce("display_name", key).alias("name"), "description", level.alias("level"), ids(F.col("ancestors.id")).alias("parent_ids"), ids(F.col("related_concepts.id")).alias("related_ids")
    )


def work_edges(works: DataFrame, concepts: DataFrame) -> DataFrame:
    """Name, source_name, target_name, year: a work cites its references or, if it names none,
    is about its concepts (their names in lower case, spaces as _); a concept is a subfield of its
    parents and related to others. Edges to things that are not there are left out."""
    there = works.select(F.col("id").alias("target_name")).unionByName(concepts.select(F.col("id").alias("target_name"))).distinct()
    none = F.lit(None).cast("int").alias("year")
    cites = works.select(F.lit("cites").alias("name"), F.col("id").alias("source_name"), F.explode("citations").alias("target_name"), "year")
    about = works.filter(F.size("citations") == 0).select(F.lit("about").alias("name"), F.col("id").alias("source_name"), F.explode("concepts").alias("c"))
    about = about.select("name", "source_name", F.replace(F.lower("c"), F.lit(" "), F.lit("_")).alias("target_name"), none)
    under = concepts.select(F.lit("subfield_of").alias("name"), F.col("id").alias("source_name"), F.explode("parent_ids").alias("target_name"), none)
    like = concepts.select(F.lit("related_to").alias("name"), F.col("id").alias("source_name"), F.explode("related_ids").alias("target_name"), none)
    return cites.unionByName(about).unionByName(under).unionByName(like).join(there, "target_name", "left_semi").select("name", "source_name", "target_name", "year")


def work_records(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, source) in the record format, one JSON string per row; the
    abstract's index is built per word, then per document."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    places = docs.select("doc_id", F.posexplode(words).alias("at", "word")).groupBy("doc_id", "word").agg(F.collect_list("at").alias("at"))
    index = places.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("abstract_inverted_index"))
    n = F.col("doc_id")
    record = docs.join(index, "doc_id", "left").select(
        F.concat(F.lit(ID_PREFIX + "W"), n).alias("id"), F.when(n % 2 == 0, F.concat(F.lit("Title "), n)).alias("title"), F.when(n % 4 == 1, F.concat(F.lit("Name "), n)).alias("display_name"),
        F.when(n % 7 > 0, (1990 + n % 40).cast("int")).alias("publication_year"), "abstract_inverted_index",
        F.array(F.struct(F.struct(F.col("source").alias("display_name")).alias("author"))).alias("authorships"),
        F.array(F.struct(F.concat_ws(" ", "lang", "source").alias("display_name"))).alias("concepts"),
        F.when(n % 3 > 0, F.array(F.concat(F.lit(ID_PREFIX + "W"), n * 2), F.concat(F.lit(ID_PREFIX + "W"), n + 1))).alias("referenced_works"),
    )
    return record.select(F.to_json(F.struct("*")).alias("value"))


def concept_records(docs: DataFrame) -> DataFrame:
    """The languages (level 0) and their sources (level 1) of documents as concept records."""
    pairs = docs.select("lang", "source").distinct()
    at = lambda *parts: F.array(F.struct(F.concat(F.lit(ID_PREFIX), *parts).alias("id")))
    top = pairs.select("lang").distinct().select(F.concat(F.lit(ID_PREFIX), "lang").alias("id"), F.col("lang").alias("display_name"), F.lit(0).alias("level"), F.lit(None).cast("array<struct<id:string>>").alias("ancestors"), at(F.lit("nowhere")).alias("related_concepts"))
    low = pairs.select(F.concat(F.lit(ID_PREFIX), "lang", F.lit("_"), "source").alias("id"), F.concat_ws(" ", "lang", "source").alias("display_name"), F.lit(1).alias("level"), at("lang").alias("ancestors"), at(F.lit("en_"), "source").alias("related_concepts"))
    return top.unionByName(low).select(F.to_json(F.struct("*")).alias("value"))


def load_signed_edges(spark: SparkSession, path: str) -> DataFrame:
    """Source, target, sign of a table with a heading and the columns source, target, source
    symbol, target symbol, is_directed, is_stimulation, is_inhibition. Symbols go before ids; rows
    that are undirected, shorter, or both or neither of the two last are left out."""
    names = "a b s t directed plus minus".split()
    rows = spark.read.schema(", ".join(f"{c} string" for c in names)).option("sep", "\t").option("header", True).option("quote", "").option("enforceSchema", True).csv(path)
    signed = rows.filter((F.col("directed") == "True") & F.col("minus").isNotNull() & ((F.col("plus") == "True") != (F.col("minus") == "True")))
    return signed.select(F.coalesce("s", "a").alias("source"), F.coalesce("t", "b").alias("target"), F.when(F.col("plus") == "True", 1).otherwise(-1).alias("sign"))
