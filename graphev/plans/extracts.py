"""Registered queries of relational extracts and of a graph's homology, with statements of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphev.functions.shared import new_dir
from graphev.operators import extract, homology
from graphev.operators.relation import Relation
from graphev.plans.catalog import frame, head
from graphev.sources import loaders

#: The star's tables as those of a bioactivity database.
TABLES: dict[str, tuple[Relation, tuple[str, ...]]] = {
    "molecules": (Relation("""SELECT s_suppkey AS molregno, concat('C', CAST(s_suppkey AS STRING)) AS chembl_id, CAST(s_nationkey % 5 AS INT) AS max_phase,
CASE s_suppkey % 4 WHEN 0 THEN upper(s_name) WHEN 1 THEN concat(upper(s_name), ' SODIUM') WHEN 2 THEN concat(s_name, ' mesylate') ELSE concat('al-', s_name, ' DISODIUM PHOSPHATE') END AS pref_name FROM {supplier}""", ("supplier",)), ("supplier",)),
    "targets": (Relation("""SELECT p_partkey AS tid, concat('T', CAST(p_partkey AS STRING)) AS target_id, CASE WHEN p_size % 4 = 0 THEN 'Mus musculus' ELSE 'Homo sapiens' END AS organism,
CASE WHEN p_type = 'SMALL' THEN 'PROTEIN FAMILY' ELSE 'SINGLE PROTEIN' END AS target_type FROM {part}""", ("part",)), ("part",)),
    "components": (Relation("SELECT p_partkey AS tid, p_partkey * 2 AS component_id FROM {part}", ("part",)), ("part",)),
    "synonyms": (Relation("""SELECT p_partkey * 2 AS component_id, CASE WHEN p_partkey % 7 > 0 THEN concat('G', CAST(p_partkey % 90 AS STRING)) END AS synonym, 'GENE_SYMBOL' AS syn_type FROM {part}
UNION ALL SELECT p_partkey * 2, p_name, 'UNIPROT' FROM {part}""", ("part",)), ("part",)),
    "mechanisms": (Relation("""SELECT l_orderkey AS mec_id, l_suppkey AS molregno, l_partkey AS tid, CASE l_returnflag WHEN 'A' THEN 'Kinase inhibitor' WHEN 'N' THEN 'Partial agonist' ELSE '' END AS mechanism_of_action,
CASE WHEN l_linestatus = 'O' THEN 'OTHER' END AS action_type FROM {lineitem} WHERE l_linenumber = 1""", ("lineitem",)), ("lineitem",)),
    "refs": (Relation("SELECT o_orderkey AS mec_id, o_custkey AS ref_id FROM {orders} WHERE o_orderstatus <> 'P'", ("orders",)), ("orders",)),
    "docs": (Relation("""SELECT c_custkey AS doc_id, CASE WHEN c_acctbal > 5000 THEN c_custkey + 1000 END AS pubmed_id, CASE WHEN c_acctbal > 2000 THEN concat('10.1/', c_mktsegment) ELSE '' END AS doi,
CASE WHEN c_nationkey > 3 THEN concat('D', CAST(c_custkey AS STRING)) END AS chembl_id FROM {customer}""", ("customer",)), ("customer",)),
    "assays": (Relation("SELECT p_partkey AS assay_id, p_partkey AS tid, CASE WHEN p_size % 3 = 0 THEN 'F' ELSE 'B' END AS assay_type, CAST(7 + p_size % 3 AS INT) AS confidence_score FROM {part}", ("part",)), ("part",)),
    "activities": (Relation("""SELECT l_suppkey AS molregno, l_partkey AS assay_id, o_custkey AS doc_id, CAST(4 + l_discount * 40 + l_linenumber / 10.0 AS DOUBLE) AS pchembl, CASE WHEN l_linenumber % 2 = 0 THEN 'IC50' ELSE 'Ki' END AS standard_type
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber > 1""", ("lineitem", "orders")), ("lineitem", "orders")),
}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: relation(*(frame(spark, sf_dir, t) for t in inputs)) for name, (relation, inputs) in TABLES.items()}


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = _tables(spark, sf_dir)
    t["activities"] = t["activities"].withColumn("pchembl", F.round("pchembl", 2))
    proteins = extract.single_proteins(t["targets"], t["components"], t["synonyms"])
    one = extract.from_mechanisms(t["mechanisms"], t["molecules"], proteins, t["refs"], t["docs"], approved_only=False)
    return one, extract.from_activities(t["activities"], t["assays"], t["molecules"], proteins, t["docs"], approved_only=False)


def _said(rows: DataFrame) -> DataFrame:
    return rows.drop("rank").withColumn("score", F.round("score", 6))


def mechanisms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(_pairs(spark, sf_dir)[0]).drop("source")


def activities_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(_pairs(spark, sf_dir)[1]).drop("source")


def merged_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(extract.first_wins(*_pairs(spark, sf_dir)))


def target_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.edges_of(extract.first_wins(*_pairs(spark, sf_dir)))


def betti_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interactions and all objects as nodes."""
    found = homology.betti(frame(spark, sf_dir, "neighbours"), frame(spark, sf_dir, "objects").select(F.col("name").alias("node")))
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{n} long" for n in found))


def drift_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interactions, and those of at least 0.8, over the same nodes."""
    edges = frame(spark, sf_dir, "strict").filter("name = 'interacts_with'").select(F.col("source_name").alias("a"), F.col("target_name").alias("b"), "confidence")
    nodes = frame(spark, sf_dir, "objects").select(F.col("name").alias("node"))
    return homology.drift(edges, edges.filter("confidence >= 0.8"), nodes)


def rips_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangles of the radius graph, each there from its longest edge on."""
    return homology.radius_triangles(frame(spark, sf_dir, "cells"), 2.0)


def graph_json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: a file of objects and edges for each disease, read back."""
    edges = frame(spark, sf_dir, "morphisms").filter("name = 'treats'")
    one = F.struct("name", F.col("source_name").alias("source"), F.col("target_name").alias("target"), F.when(F.col("confidence") < 1, F.col("confidence")).alias("confidence"))
    whole = edges.groupBy("target_name").agg(F.collect_list(one).alias("morphisms"), F.array(F.struct(F.first("target_name").alias("name"), F.lit(None).cast("string").alias("type_name"))).alias("objects"))
    folder = new_dir(spark, "graph-json")
    whole.drop("target_name").write.option("maxRecordsPerFile", 1).json(folder)
    objects, read = loaders.load_graph_json(spark, f"{folder}/part-*")
    said = objects.select(F.lit("object").alias("part"), "name", F.col("type_name").alias("source_name"), F.lit(None).cast("string").alias("target_name"), F.lit(None).cast("double").alias("confidence"))
    return said.unionByName(read.select(F.lit("edge").alias("part"), "name", "source_name", "target_name", "confidence"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a10_mechanism_pairs": mechanisms_query,
    "a11_activity_pairs": activities_query,
    "a12_drug_targets": merged_query,
    "a13_target_edges": target_edges_query,
    "a4_graph_json": graph_json_query,
    "i7_betti": betti_query,
    "i9_rips_triangles": rips_query,
    "i10_drift": drift_query,
}

_NAME = "CASE molregno % 4 WHEN 0 THEN 'Supplier#' || right(pref_name, 9) WHEN 3 THEN 'Al-Supplier#' || substring(pref_name, 13, 9) || ' Disodium' ELSE 'Supplier#' || substring(pref_name, 10, 9) END"
_SQL = f"""WITH {', '.join(f"{name} AS MATERIALIZED ({relation.duckdb(*inputs)})" for name, (relation, inputs) in TABLES.items())},
prot AS (SELECT DISTINCT targets.tid, target_id, synonym AS target FROM targets JOIN components ON components.tid = targets.tid JOIN synonyms ON synonyms.component_id = components.component_id WHERE organism LIKE 'Homo%' AND target_type LIKE 'SINGLE%' AND syn_type = 'GENE_SYMBOL' AND synonym IS NOT NULL),
mol AS (SELECT *, {_NAME} AS drug, least(1, (40 + 15 * max_phase) / 100.0::DOUBLE) AS ps FROM molecules WHERE max_phase > 0),
a10 AS MATERIALIZED (SELECT DISTINCT drug, target, mol.chembl_id AS drug_id, target_id, round(ps, 6) AS score, coalesce(action_type, 'unknown') || ': ' || CASE mechanism_of_action WHEN '' THEN 'unknown' ELSE mechanism_of_action END AS moa, max_phase AS phase,
  CASE WHEN pubmed_id IS NOT NULL THEN 'PMID:' || pubmed_id WHEN doi <> '' THEN 'DOI:' || doi ELSE 'ChEMBL:' || mol.chembl_id END AS provenance, pref_name
  FROM mechanisms JOIN mol USING (molregno) JOIN prot USING (tid) LEFT JOIN refs USING (mec_id) LEFT JOIN docs ON docs.doc_id = refs.ref_id),
a11 AS MATERIALIZED (SELECT DISTINCT drug, target, mol.chembl_id AS drug_id, target_id, round(0.7::DOUBLE * least(1, 0.4::DOUBLE + 0.12::DOUBLE * (round(pchembl, 2) - 5)) + 0.3::DOUBLE * ps, 6) AS score, standard_type || ': pChEMBL=' || printf('%.1f', round(pchembl, 2)) AS moa, max_phase AS phase,
  CASE WHEN pubmed_id IS NOT NULL THEN 'PMID:' || pubmed_id WHEN doi <> '' THEN 'DOI:' || doi WHEN docs.chembl_id IS NOT NULL THEN 'ChEMBL_DOC:' || docs.chembl_id ELSE 'ChEMBL:' || mol.chembl_id END AS provenance, pref_name, round(pchembl, 2) AS pchembl
  FROM activities JOIN mol USING (molregno) JOIN assays USING (assay_id) JOIN prot ON prot.tid = assays.tid LEFT JOIN docs USING (doc_id) WHERE round(pchembl, 2) >= 6 AND assay_type = 'B' AND confidence_score >= 8),
a12 AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY drug, target ORDER BY source DESC, x DESC, y DESC, pref_name, drug_id, target_id, score, moa, phase, provenance) AS k FROM
  (SELECT drug, target, drug_id, target_id, score, moa, phase, provenance, 'mechanism' AS source, phase::DOUBLE AS x, 0.0::DOUBLE AS y, pref_name FROM a10 UNION ALL SELECT drug, target, drug_id, target_id, score, moa, phase, provenance, 'bioactivity', pchembl, phase, pref_name FROM a11) q) p WHERE k = 1)"""
_CLASS = "CASE WHEN moa ILIKE '%inhibitor%' THEN 'inhibits' WHEN moa ILIKE '%agonist%' THEN 'activates' WHEN moa ILIKE 'ic50%' OR moa ILIKE 'ki:%' THEN 'binds' ELSE 'targets' END"

ORACLES: dict[str, str] = {
    "a10_mechanism_pairs": f"{_SQL} SELECT * EXCLUDE (pref_name) FROM a10",
    "a11_activity_pairs": f"{_SQL} SELECT * EXCLUDE (pref_name, pchembl) FROM a11",
    "a12_drug_targets": f"{_SQL} SELECT * EXCLUDE (x, y, pref_name) FROM a12",
    "a13_target_edges": f"{_SQL} SELECT drug AS source, target, {_CLASS} AS relation, round(score, 3) AS confidence, provenance FROM a12",
    "a4_graph_json": f"{head('morphisms')}, t AS (SELECT * FROM n_morphisms WHERE name = 'treats') SELECT 'object' AS part, target_name AS name, 'Object' AS source_name, NULL AS target_name, NULL::DOUBLE AS confidence FROM t GROUP BY target_name UNION ALL SELECT 'edge', name, source_name, target_name, 1.0::DOUBLE FROM t",
    # cells by their distances, not by a grid
    "i9_rips_triangles": f"""{head('cells')}, e AS MATERIALIZED (SELECT a.cell AS a, b.cell AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM n_cells a JOIN n_cells b ON a.cell < b.cell WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4)
SELECT x.a AS u, x.b AS v, y.b AS w, round(1e-11 + greatest(x.d, y.d, z.d), 6) AS filtration FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b""",
    # smallest labels over twelve rounds of neighbours
    "i7_components": f"{head('neighbours')}, l0 AS (SELECT DISTINCT a AS node, a AS root FROM n_neighbours), "
    + ", ".join(f"l{k} AS MATERIALIZED (SELECT l.node, least(any_value(l.root), min(m.root)) AS root FROM l{k - 1} l JOIN n_neighbours n ON n.a = l.node JOIN l{k - 1} m ON m.node = n.b GROUP BY l.node)" for k in range(1, 13))
    + " SELECT node, root FROM l12",
}
