"""Phrase joins: which names contain which phrases, word by word.

Words are lower-cased stretches of [a-z0-9]. A phrase is looked up by its rarest word among all names,
so that a common word brings no candidates of its own, and then compared where it would have to stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphev.functions.shared import saved

#: Words that name a salt or form of a drug.
SALTS = ["anhydrous", "citrate", "fumarate", "hydrate", "hydrochloride", "malate", "mesilate", "mesylate", "phosphate", "potassium", "s", "sodium", "sulfate"]


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def without_salts(c: Column) -> Column:
    return F.array_join(F.filter(words(c), lambda w: ~w.isin(*SALTS)), " ")


def phrase_hits(names: DataFrame, phrases: DataFrame) -> DataFrame:
    """names (id, name), phrases (key, phrase) -> (id, key) of every name that contains a phrase of the
    key as whole words in a row. Phrases without words are in nothing."""
    said = names.select("id", words(F.col("name")).alias("w")).distinct()
    place = saved(said.select("id", "w", F.posexplode("w").alias("at", "word")))
    counts = place.groupBy("word").agg(F.count("*").alias("n"))
    asked = saved(phrases.select("key", words(F.col("phrase")).alias("p")).filter("size(p) > 0").distinct())
    # a word that no name has counts 0: its phrase is in no name
    rare = asked.select("key", "p", F.posexplode("p").alias("off", "word")).join(counts, "word", "left").groupBy("key", "p").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "word")).alias("r"))
    rare = rare.filter("r.n > 0").select("key", "p", "r.off", F.col("r.word").alias("word"))
    met = place.join(rare, "word").filter("at >= off and slice(w, at - off + 1, size(p)) = p")
    return met.select("id", "key").distinct()


def named_alike(names: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, key) of every name that is a phrase of the key but for salts."""
    x = names.select("id", without_salts(F.col("name")).alias("bare"))
    y = phrases.select("key", without_salts(F.col("phrase")).alias("bare")).filter("bare <> ''")
    return x.join(y, "bare").select("id", "key").distinct()


def trial_pairs(interventions: DataFrame, conditions: DataFrame, drugs: DataFrame, diseases: DataFrame) -> DataFrame:
    """Interventions and conditions (id, name) of trials, drugs and diseases (key, phrase), all their
    aliases -> (id, drug, disease). A drug is one of the interventions if it is it but for salts, or stands
    in it as a phrase; a disease only as a phrase of its aliases."""
    drug = phrase_hits(interventions, drugs).unionByName(named_alike(interventions, drugs)).distinct()
    disease = phrase_hits(conditions, diseases)
    return drug.withColumnRenamed("key", "drug").join(disease.withColumnRenamed("key", "disease"), "id")
