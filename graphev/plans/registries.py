"""Registered queries of the record readers, over records made from the star's tables and written as files,
with statements of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphev.functions.shared import new_dir
from graphev.plans.catalog import frame, head
from graphev.sources import registries


def _lines(spark: SparkSession, name: str, rows: DataFrame) -> str:
    folder = new_dir(spark, name)
    rows.write.text(folder)
    return folder


def entities_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities: their type, a time, a string and an unknown property; those of two types."""
    claims = F.expr("""named_struct('P31', array(named_struct('mainsnak', named_struct('datavalue', named_struct('type', 'wikibase-entityid', 'value', named_struct('id', concat('Q', p_type)))))),
 'P569', array(named_struct('mainsnak', named_struct('datavalue', named_struct('type', 'time', 'value', named_struct('time', concat('+', cast(1900 + p_size as string))))))),
 'P7', array(named_struct('mainsnak', named_struct('datavalue', named_struct('type', 'string', 'value', p_brand))), named_struct('mainsnak', named_struct('datavalue', named_struct('type', 'quantity', 'value', '1')))),
 'P8', array(named_struct('mainsnak', named_struct('datavalue', named_struct('type', 'quantity', 'value', '2')))))""")
    label = F.expr("if(p_partkey % 3 = 0, named_struct('de', named_struct('value', 'x'), 'en', null), named_struct('de', null, 'en', named_struct('value', p_name)))")
    one = F.to_json(F.struct(F.expr("concat('Q', cast(p_partkey as string))").alias("id"), label.alias("labels"), F.expr("named_struct('en', array(named_struct('value', p_brand), named_struct('value', p_type)))").alias("aliases"), claims.alias("claims")))
    path = _lines(spark, "entities", frame(spark, sf_dir, "part").select(F.concat(one, F.lit(",")).alias("value")))
    rows = registries.load_entities(spark, path, ["QECONOMY", "QSMALL"])
    said = F.array_join(F.array_sort(F.transform(F.map_entries("claims"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))), ";")
    return rows.select("id", "label", F.array_join("aliases", "|").alias("aliases"), said.alias("claims"))


def interactions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored interactions of suppliers and parts; every fifth row has no channels."""
    n = lambda c: f"cast({c} as string)"
    fields = f"concat_ws('\t', concat('9606.', {n('l_suppkey')}), concat('9606.', {n('l_partkey')}), concat('S', {n('l_suppkey')}), concat('P', {n('l_partkey')}), '9606', {n('l_orderkey % 1000')})"
    more = f"concat_ws('\t', '0', '0', '0', {n('l_linenumber % 2')}, {n('l_discount')}, {n('l_tax')}, {n('l_partkey % 3')})"
    rows = frame(spark, sf_dir, "lineitem").select(F.expr(f"if(l_orderkey % 5 = 0, {fields}, concat({fields}, '\t', {more}))").alias("value"))
    return registries.load_interactions(spark, _lines(spark, "interactions", rows)).groupBy("a", "b", "evidence").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


def associations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' parts and nations, scored; a pair's parts are its line items' numbers."""
    rows = frame(spark, sf_dir, "lineitem").join(frame(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(frame(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.expr("element_at(array('literature', 'known_drug', 'somatic_mutation', 'genetic_association', 'animal_model', 'else'), cast((l_orderkey + l_linenumber) % 6 + 1 as int))")
    # nations are moved by one, so that some pairs have no edge yet
    rows = rows.select(F.expr("concat('P', cast(l_partkey as string))").alias("protein"), F.expr("concat('N', cast((c_nationkey + 1) % 26 as string))").alias("disease"), kind.alias("id"), (100 * F.col("l_discount")).cast("int").alias("score"))
    scores = rows.groupBy("protein", "disease", "id").agg(F.max("score").alias("score")).groupBy("protein", "disease").agg((F.sum("score") / 100.0).alias("overall"), F.collect_list(F.struct("id", "score")).alias("parts"))
    return registries.associations(scores, frame(spark, sf_dir, "objects"), frame(spark, sf_dir, "morphisms").filter("created_at < '1998-01-01'"))


def studies_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as study records, a reference for each digit of the price."""
    one = F.expr("""to_json(named_struct('hasResults', if(o_orderstatus = 'F', true, null), 'protocolSection', named_struct('identificationModule', named_struct('nctId', concat('NCT', cast(o_orderkey as string)), 'briefTitle', o_orderpriority),
 'statusModule', named_struct('overallStatus', nullif(o_orderstatus, 'P'), 'completionDateStruct', named_struct('date', cast(cast(o_orderdate as date) as string))), 'designModule', if(o_custkey % 4 = 0, null, named_struct('enrollmentInfo', named_struct('count', o_custkey, 'type', 'ACTUAL'))),
 'referencesModule', named_struct('references', array(named_struct('pmid', cast(o_custkey as string), 'type', 'RESULT'), named_struct('pmid', cast(o_orderkey as string), 'type', if(o_orderkey % 2 = 0, 'BACKGROUND', null)), named_struct('pmid', '', 'type', 'DERIVED')))),
 'resultsSection', if(o_orderkey % 3 = 0, named_struct('outcomeMeasuresModule', named_struct('outcomeMeasures', transform(sequence(1, cast(o_orderkey % 15 + 1 as int)), i -> named_struct('title', cast(i as string)))), 'participantFlowModule', named_struct('x', if(o_orderkey % 2 = 0, 1, null))), null)))""")
    rows = registries.studies(spark.read.text(_lines(spark, "studies", frame(spark, sf_dir, "orders").select(one.alias("value")))))
    return rows.withColumns({c: F.array_join(c, "|") for c in ("result_pmids", "derived_pmids", "background_pmids", "outcome_measure_titles")}).withColumn("outcome_measure_count", F.col("outcome_measure_count").cast("long"))


def external_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations as an external network under other spellings, written compressed."""
    nodes_at, edges_at = new_dir(spark, "net-nodes"), new_dir(spark, "net-edges")
    supplier, nation = frame(spark, sf_dir, "supplier"), frame(spark, sf_dir, "nation")
    nodes = supplier.select(F.expr("concat('c', cast(s_suppkey as string))").alias("id"), F.lower("s_name").alias("name")).unionByName(nation.select(F.expr("concat('d', cast(n_nationkey as string))").alias("id"), F.expr("initcap(replace(n_name, '_', ' '))").alias("name")))
    edges = supplier.select(F.expr("concat('c', cast(s_suppkey as string))").alias("source"), F.expr("if(s_suppkey % 3 = 0, 'CpD', 'CtD')").alias("metaedge"), F.expr("concat('d', cast(s_nationkey + 2 as string))").alias("target"))
    for rows, at in ((nodes, nodes_at), (edges, edges_at)):
        rows.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(at)
    return registries.external_pairs(*registries.load_network(spark, nodes_at, edges_at), supplier.select(F.col("s_name").alias("name")), nation.select(F.col("n_name").alias("name")))


def domain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drug-target edge: the drug's groups by its number, the target's domain by its type."""
    groups = F.expr("transform(filter(sequence(0, 11), i -> (drug * 7 + i * 5) % 4 = 0), i -> element_at(array('Amine', 'amide', 'PYRIDINE', 'indole', 'hydroxyl', 'carboxyl', 'sulfonamide', 'aromatic', 'fluoride', 'ether', 'glutarimide', 'amine'), i + 1))")
    domain = F.expr("element_at(array('kinase', 'protease', 'cyclooxygenase', 'gtpase', 'bcl2_family', 'ubiquitin_ligase', 'gpcr', ''), int(target % 8) + 1)")
    rows = frame(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("drug"), F.col("l_partkey").alias("target")).distinct()
    return rows.select("drug", "target", F.round(registries.domain_match(groups, domain), 6).alias("score"))


def sinks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations written as a worklist and as a report, and what the files say in the end."""
    csv, report = new_dir(spark, "worklist"), new_dir(spark, "report")
    registries.write_worklist(frame(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), csv, "s_suppkey")
    registries.write_report(frame(spark, sf_dir, "nation").select("n_regionkey", "n_name"), report, "n_name")
    lines = spark.read.text(report).select(F.lit("report").alias("file"), F.col("value").alias("line"))
    return spark.read.option("header", True).csv(csv).select(F.lit("worklist").alias("file"), F.concat_ws(",", "s_suppkey", "s_name").alias("line")).unionByName(lines)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a9_entities": entities_query, "a15_interaction_channels": interactions_query, "a16_associations": associations_query, "a18_studies": studies_query, "a19_external_pairs": external_query,
    "a26_sinks": sinks_query, "d3d_domain_match": domain_query,
}
ORACLES: dict[str, str] = {
    "a9_entities": """SELECT 'Q' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Q' || p_partkey ELSE p_name END AS label, p_brand || '|' || p_type AS aliases,
'P7=' || p_brand || ';date_of_birth=+' || (1900 + p_size) || ';instance_of=Q' || p_type AS claims FROM part WHERE p_type IN ('ECONOMY', 'SMALL')""",
    "a15_interaction_channels": """SELECT 'S' || l_suppkey AS a, 'P' || l_partkey AS b, CASE WHEN l_orderkey % 5 = 0 OR (l_discount = 0 AND l_tax = 0 AND l_partkey % 3 = 0 AND l_linenumber % 2 = 0) THEN 'combined'
ELSE concat_ws('+', CASE WHEN l_discount > 0 THEN 'experimental' END, CASE WHEN l_tax > 0 THEN 'database' END, CASE WHEN l_partkey % 3 > 0 THEN 'textmining' END, CASE WHEN l_linenumber % 2 = 1 THEN 'coexpression' END) END AS evidence,
count(*) AS n, round(max((l_orderkey % 1000) / 1000.0::DOUBLE), 6) AS best FROM lineitem GROUP BY 1, 2, 3""",
    "a16_associations": f"""{head('objects', 'morphisms')}, x AS (SELECT 'P' || l_partkey AS p, 'N' || ((c_nationkey + 1) % 26) AS d, (l_orderkey + l_linenumber) % 6 AS k, max((100 * l_discount)::DOUBLE::INTEGER) AS s
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
y AS (SELECT p, d, sum(s) / 100.0::DOUBLE AS overall, min(CASE WHEN s > 0 THEN CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 0 THEN 4 WHEN 4 THEN 5 ELSE 9 END ELSE 9 END) AS best,
coalesce(string_agg(CASE k WHEN 0 THEN 'literature' WHEN 1 THEN 'known_drug' WHEN 2 THEN 'somatic_mutation' WHEN 3 THEN 'genetic_association' WHEN 4 THEN 'animal_model' ELSE 'else' END || '=' || s, ';' ORDER BY CASE k WHEN 0 THEN 'literature' WHEN 1 THEN 'known_drug' WHEN 2 THEN 'somatic_mutation' WHEN 3 THEN 'genetic_association' WHEN 4 THEN 'animal_model' ELSE 'else' END) FILTER (WHERE s > 0), '') AS breakdown FROM x GROUP BY p, d)
SELECT p AS source_name, d AS target_name, p || '_to_' || d AS name, overall AS confidence, CASE best WHEN 1 THEN 'MEASURED' WHEN 2 THEN 'ESTABLISHED' WHEN 3 THEN 'ESTABLISHED' WHEN 5 THEN 'INFERRED' ELSE 'HYPOTHESIS' END AS evidence_tier, printf('OpenTargets_score_%.3f', overall) AS provenance, breakdown
FROM y WHERE p IN (SELECT name FROM n_objects WHERE type_name = 'Protein') AND d IN (SELECT name FROM n_objects WHERE type_name = 'Disease') AND NOT EXISTS (SELECT 1 FROM n_morphisms m WHERE m.source_name = p AND m.target_name = d AND created_at < '1998-01-01')""",
    "a18_studies": """SELECT 'NCT' || o_orderkey AS nct_id, o_orderpriority AS title, CASE o_orderstatus WHEN 'P' THEN 'UNKNOWN' ELSE o_orderstatus END AS status, '' AS why_stopped, o_orderdate::DATE::VARCHAR AS completion_date, o_orderstatus = 'F' AS has_results,
CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS enrollment_count, CASE WHEN o_custkey % 4 > 0 THEN 'ACTUAL' ELSE '' END AS enrollment_type, o_custkey::VARCHAR AS result_pmids, '' AS derived_pmids, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE '' END AS background_pmids,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 15 + 1 ELSE 0 END::BIGINT AS outcome_measure_count, CASE WHEN o_orderkey % 3 = 0 THEN array_to_string(range(1, least(12, o_orderkey % 15 + 1) + 1), '|') ELSE '' END AS outcome_measure_titles, o_orderkey % 6 = 0 AS has_participant_flow FROM orders""",
    "a19_external_pairs": "SELECT DISTINCT s_name AS drug, n_name AS disease FROM supplier JOIN nation ON n_nationkey = s_nationkey + 2 WHERE s_suppkey % 3 > 0",
    "a26_sinks": """SELECT 'worklist' AS file, s_suppkey || ',' || s_name AS line FROM supplier UNION ALL SELECT 'report', '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' FROM nation""",
    "d3d_domain_match": """WITH e AS (SELECT DISTINCT l_suppkey AS drug, l_partkey AS target FROM lineitem), g AS (SELECT *, list_distinct(list_transform(list_filter(range(0, 12), lambda i: (drug * 7 + i * 5) % 4 = 0), lambda i: ['amine', 'amide', 'pyridine', 'indole', 'hydroxyl', 'carboxyl', 'sulfonamide', 'aromatic', 'fluoride', 'ether', 'glutarimide', 'amine'][i + 1])) AS g FROM e)
SELECT drug, target, round(0.5::DOUBLE + CASE target % 8 WHEN 0 THEN least(0.4, 0.1 * len(list_filter(g, lambda x: x IN ('amine', 'amide', 'pyridine', 'indole')))) WHEN 1 THEN least(0.3, 0.1 * len(list_filter(g, lambda x: x IN ('hydroxyl', 'amide', 'carboxyl'))))
WHEN 2 THEN least(0.3, 0.1 * len(list_filter(g, lambda x: x IN ('carboxyl', 'sulfonamide', 'aromatic')))) WHEN 3 THEN 0.1 * len(list_filter(g, lambda x: x = 'fluoride')) WHEN 4 THEN least(0.3, 0.1 * len(list_filter(g, lambda x: x IN ('sulfonamide', 'aromatic', 'ether'))))
WHEN 5 THEN 0.15 * len(list_filter(g, lambda x: x IN ('glutarimide', 'amide'))) WHEN 6 THEN least(0.2, 0.05 * len(list_filter(g, lambda x: x IN ('amine', 'amide', 'hydroxyl')))) ELSE 0 END, 6) AS score FROM g""",
}
