"""Readers of registry and knowledge-base records: entities with claims, studies, interaction channels,
association scores, external networks; and the sinks of worklists and reports.

Semi-structured records are read by path: a schema names the paths that are wanted, and everything else is
skipped by Spark's JSON parser. Property names are data (a map). A record that cannot be read is left
out, and missing parts are null or empty, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------
PROPERTIES = {
    "P31": "instance_of", "P279": "subclass_of", "P361": "part_of", "P527": "has_part", "P737": "influenced_by", "P800": "notable_work", "P101": "field_of_work", "P1066": "student_of",
    "P185": "doctoral_student", "P569": "date_of_birth", "P570": "date_of_death", "P19": "place_of_birth", "P108": "employer", "P112": "founded_by", "P135": "movement", "P1344": "participant_in",
}
TIERS = {
    "known_drug": "MEASURED", "somatic_mutation": "ESTABLISHED", "genetic_association": "ESTABLISHED", "literature": "HYPOTHESIS", "affected_pathway": "INFERRED", "animal_model": "INFERRED",
    "rna_expression": "INFERRED",
}
CHANNELS = {"escore": "experimental", "dscore": "database", "tscore": "textmining", "ascore": "coexpression"}
#: domain: the groups that fit it, the most they add, what each adds; '' stands for any other domain
DOMAINS = {
    "kinase": (["amine", "amide", "pyrimidine", "pyridine", "quinazoline", "pyrazole", "indole"], 0.4, 0.1),
    "protease": (["hydroxyl", "amide", "carboxyl", "tetracycline"], 0.3, 0.1),
    "cyclooxygenase": (["carboxyl", "sulfonamide", "aromatic"], 0.3, 0.1),
    "gtpase": (["acrylamide", "fluoride", "piperazine"], 0.3, 0.1),
    "bcl2_family": (["sulfonamide", "chloride", "aromatic", "ether"], 0.3, 0.1),
    "ubiquitin_ligase": (["glutarimide", "phthalimide", "amide"], 0.4, 0.15),
    "": (["amine", "amide", "hydroxyl", "carbonyl"], 0.2, 0.05),
}
# ----------------------------------------------------------------------------------------------------------

_TEXT = "map<string, struct<value: string>>"
ENTITY = f"struct<id: string, labels: {_TEXT}, descriptions: {_TEXT}, aliases: map<string, array<struct<value: string>>>, claims: map<string, array<struct<mainsnak: struct<datavalue: struct<type: string, value: string>>>>>, sitelinks: map<string, struct<title: string>>>"
STUDY = (
    "struct<hasResults: boolean, protocolSection: struct<identificationModule: struct<nctId: string, briefTitle: string>, statusModule: struct<overallStatus: string, whyStopped: string, completionDateStruct: struct<date: string>>,"
    " designModule: struct<enrollmentInfo: struct<count: long, type: string>>, referencesModule: struct<references: array<struct<pmid: string, type: string>>>>,"
    " resultsSection: struct<outcomeMeasuresModule: struct<outcomeMeasures: array<struct<title: string>>>, participantFlowModule: string>>"
)


def json_lines(lines: DataFrame, kind: str) -> DataFrame:
    """value (text) -> r (the record): lines of objects, of objects with commas behind them, or of whole
    arrays; brackets alone on a line, blank and broken lines give nothing."""
    line = F.regexp_replace(F.trim(F.coalesce("value", F.lit(""))), r",\s*$", "")
    rows = lines.select(line.alias("line")).filter("line not in ('', '[', ']')")
    read = F.when(F.startswith(F.col("line"), F.lit("[")), F.from_json("line", f"array<{kind}>")).otherwise(F.array(F.from_json("line", kind)))
    return rows.select(F.explode(read).alias("r")).filter("r is not null")


def entities(lines: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Lines of entity records -> id, label (English, else the id), description, aliases, claims (name:
    values, of entities, times and strings), sitelinks. With types: those that are an instance of one."""
    rows = json_lines(lines, ENTITY).filter("r.id <> ''").select("r.*")
    names = F.create_map(*[F.lit(x) for pair in PROPERTIES.items() for x in pair])

    def values(snaks: Column) -> Column:
        said = F.transform(snaks, lambda s: s["mainsnak"]["datavalue"])
        read = F.transform(said, lambda d: F.when(d["type"] == "wikibase-entityid", F.get_json_object(d["value"], "$.id")).when(d["type"] == "time", F.get_json_object(d["value"], "$.time")).when(d["type"] == "string", F.coalesce(d["value"], F.lit(""))))
        return F.filter(read, lambda v: v.isNotNull() & ((v != "") | F.exists(said, lambda d: (d["type"] == "string") & (F.coalesce(d["value"], F.lit("")) == v))))

    claims = F.transform_values(F.coalesce("claims", F.create_map().cast("map<string, array<struct<mainsnak: struct<datavalue: struct<type: string, value: string>>>>>")), lambda _, v: values(v))
    claims = F.transform_keys(F.map_filter(claims, lambda _, v: F.size(v) > 0), lambda k, _: F.coalesce(names[k], k))
    out = rows.select(
        "id", F.coalesce(F.nullif(F.col("labels")["en"]["value"], F.lit("")), "id").alias("label"), F.col("descriptions")["en"]["value"].alias("description"),
        F.coalesce(F.transform(F.col("aliases")["en"], lambda a: a["value"]), F.array().cast("array<string>")).alias("aliases"), claims.alias("claims"),
        F.transform_values("sitelinks", lambda _, v: F.coalesce(v["title"], F.lit(""))).alias("sitelinks"),
    )
    return out.filter(F.arrays_overlap(F.coalesce(F.col("claims")["instance_of"], F.array().cast("array<string>")), F.array(*[F.lit(t) for t in types]))) if types else out


def load_entities(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    return entities(spark.read.text(path), types)


def studies(lines: DataFrame) -> DataFrame:
    """Lines of nested study records -> one flat row each. Citations count by their type."""
    p = F.col("r.protocolSection")
    refs = F.coalesce(p["referencesModule"]["references"], F.array().cast("array<struct<pmid: string, type: string>>"))
    of = lambda kind: F.transform(F.filter(refs, lambda x: (x["pmid"] != "") & (F.coalesce(x["type"], F.lit("UNKNOWN")) == kind)), lambda x: x["pmid"])
    said = lambda c, default="": F.coalesce(c, F.lit(default))
    measures = F.coalesce(F.col("r.resultsSection.outcomeMeasuresModule.outcomeMeasures"), F.array().cast("array<struct<title: string>>"))
    flow = F.coalesce(F.col("r.resultsSection.participantFlowModule"), F.lit("{}"))
    return json_lines(lines, STUDY).select(
        said(p["identificationModule"]["nctId"]).alias("nct_id"), said(p["identificationModule"]["briefTitle"]).alias("title"), said(p["statusModule"]["overallStatus"], "UNKNOWN").alias("status"),
        said(p["statusModule"]["whyStopped"]).alias("why_stopped"), said(p["statusModule"]["completionDateStruct"]["date"]).alias("completion_date"), F.coalesce("r.hasResults", F.lit(False)).alias("has_results"),
        p["designModule"]["enrollmentInfo"]["count"].alias("enrollment_count"), said(p["designModule"]["enrollmentInfo"]["type"]).alias("enrollment_type"), of("RESULT").alias("result_pmids"), of("DERIVED").alias("derived_pmids"),
        of("BACKGROUND").alias("background_pmids"), F.size(measures).alias("outcome_measure_count"),
        F.filter(F.transform(F.slice(measures, 1, 12), lambda m: m["title"]), lambda t: t != "").alias("outcome_measure_titles"), (~F.regexp_replace(flow, r"\s", "").isin("{}", "")).alias("has_participant_flow"),
    )


def load_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows without a head: two ids, two names, a taxon, the score, then the scores
    nscore, fscore, pscore, ascore, escore, dscore, tscore -> a, b, score (thousandths), evidence: the
    channels above 0, or combined. Rows of fewer than six fields are left out."""
    names = ["id_a", "id_b", "a", "b", "taxon", "score", "nscore", "fscore", "pscore", "ascore", "escore", "dscore", "tscore"]
    rows = spark.read.option("sep", "\t").schema(", ".join(f"{n} {'double' if n.endswith('score') else 'string'}" for n in names)).csv(path).filter("score is not null")
    heard = F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(n)) for c, n in CHANNELS.items()]), lambda x: x.isNotNull())
    # all channels or none: a short row says only the score
    evidence = F.when(F.col("tscore").isNotNull() & (F.size(heard) > 0), F.array_join(heard, "+")).otherwise("combined")
    return rows.select("a", "b", (F.col("score") / 1000.0).alias("score"), evidence.alias("evidence"))


def associations(scores: DataFrame, objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Scores (protein, disease, overall, parts: array of (id, score)), objects (name, type_name), edges
    (source_name, target_name) -> new edges with their tier (of the first data type in order that has a
    score above 0) and breakdown. Pairs with an unknown end or an edge already are left out."""
    has = lambda kind: F.exists("parts", lambda x: (x["id"] == kind) & (x["score"] > 0))
    tier = F.coalesce(*[F.when(has(kind), F.lit(t)) for kind, t in TIERS.items()], F.lit("HYPOTHESIS"))
    known = lambda kind, to: objects.filter(F.col("type_name") == kind).select(F.col("name").alias(to)).distinct()
    rows = scores.join(known("Protein", "protein"), "protein", "left_semi").join(known("Disease", "disease"), "disease", "left_semi")
    rows = rows.join(edges.select(F.col("source_name").alias("protein"), F.col("target_name").alias("disease")), ["protein", "disease"], "left_anti")
    parts = F.array_sort(F.transform(F.filter("parts", lambda x: x["score"] > 0), lambda x: F.concat(x["id"], F.lit("="), x["score"].cast("string"))))
    return rows.select(
        F.col("protein").alias("source_name"), F.col("disease").alias("target_name"), F.concat("protein", F.lit("_to_"), "disease").alias("name"), F.col("overall").alias("confidence"), tier.alias("evidence_tier"),
        F.format_string("OpenTargets_score_%.3f", "overall").alias("provenance"), F.array_join(parts, ";").alias("breakdown"),
    )


def plain_name(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" "))


def external_pairs(nodes: DataFrame, edges: DataFrame, drugs: DataFrame, diseases: DataFrame, edge: str = "CtD") -> DataFrame:
    """A network's nodes (id, name) and edges (source, metaedge, target), own drugs and diseases (name)
    -> (drug, disease) under the own names, matched without case and underscores."""
    pairs = edges.filter(F.col("metaedge") == edge).select("source", "target").distinct()
    named = lambda to: nodes.select(F.col("id").alias(to), plain_name(F.col("name")).alias(f"n_{to}"))
    own = lambda rows, to: rows.select(plain_name(F.col("name")).alias(f"n_{to}"), F.col("name").alias("drug" if to == "source" else "disease"))
    pairs = pairs.join(named("source"), "source").join(named("target"), "target")
    return pairs.join(own(drugs, "source"), "n_source").join(own(diseases, "target"), "n_target").select("drug", "disease").distinct()


def load_network(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Tab-separated with a head; compressed files are read as they are."""
    read = spark.read.option("sep", "\t").option("header", True)
    return read.csv(nodes), read.csv(edges)


def domain_match(groups: Column, domain: Column) -> Column:
    """D3d: 0.5, and for each of the drug's functional groups that fits the target's domain some more; null
    for no groups at all."""
    low = F.array_distinct(F.transform(groups, F.lower))

    def added(name: str) -> Column:
        fits, most, each = DOMAINS[name]
        return F.least(F.lit(most), F.size(F.array_intersect(low, F.array(*[F.lit(g) for g in fits]))) * each)

    more = F.when(F.coalesce(domain, F.lit("")) == "", F.lit(0.0))
    for name in DOMAINS:
        more = more.when(domain == name, added(name)) if name else more
    return F.when(groups.isNotNull(), F.least(F.lit(1.0), 0.5 + more.otherwise(added(""))))


def write_worklist(rows: DataFrame, path: str, *order: str) -> None:
    """A worklist as CSV with a head, in order over all its files."""
    rows.orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str, *order: str) -> None:
    """A report as JSON lines, keys in order, in order over all its files."""
    rows.select(*sorted(rows.columns)).orderBy(*order).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
