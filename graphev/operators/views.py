"""Graph views: cohorts, quality tiers, label removal and summaries.

objects: name, type_name, size_value, birth, sector, cohort. morphisms: id, name, source_name,
target_name, confidence, created_at, provenance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphev.operators.relation import Relation, Stepped

#: Fixed values.
BRIDGE_MARKERS = ["via_drug", "Drug-Target-Disease", "Drug(", "ABPP:", "ChEMBL:via_drug_"]
GOLD = ["ChEMBL:", "FDA:", "KEGG:", "ESM2:", "STRING", "ABPP"]
SILVER = GOLD + ["cancer_proteins", "aml_proteins", "PMID:", "PPI", "established:", "mechanism:", "DepMap", "GTEx"]
NOT_INTERMEDIATE = "'Drug', 'Disease'"


def any_of(column: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in marks) + ")"


GRAPH = ("objects", "morphisms")

TYPED = Relation(
    """SELECT m.*, s.type_name AS source_type, t.type_name AS target_type, s.cohort AS source_cohort, t.cohort AS target_cohort
FROM {morphisms} m JOIN {objects} s ON m.source_name = s.name JOIN {objects} t ON m.target_name = t.name""",
    GRAPH,
    note="edges with the types of their ends",
)

page_of_objects = Relation(
    "SELECT name, type_name FROM {objects} ORDER BY birth, name LIMIT :page OFFSET :skip", ("objects",), {"page": 100, "skip": 20}, "A1: objects in order, by page"
)
upsert_edges = Relation(
    """SELECT id, min(created_at) AS created_at, max_by(confidence, concat(CAST(created_at AS STRING), provenance)) AS confidence, count(*) AS versions
FROM (SELECT id, created_at, confidence, provenance FROM {morphisms} UNION ALL
  SELECT id, created_at + INTERVAL 1 DAY, round(confidence * 0.5, 6), provenance FROM {morphisms} WHERE confidence > 0.8) GROUP BY id""",
    ("morphisms",), {}, "A23: insert or update by id; first creation time, last other fields",
)
cascade_delete = Relation(
    """SELECT m.id FROM {morphisms} m WHERE NOT EXISTS (SELECT 1 FROM {objects} o WHERE o.type_name = :gone AND o.name = m.source_name)
AND NOT EXISTS (SELECT 1 FROM {objects} o WHERE o.type_name = :gone AND o.name = m.target_name)""",
    GRAPH, {"gone": "TumorSuppressor"}, "A25: what is left of the edges when the objects of a type go",
)
undirected_interactions = Relation(
    """WITH u AS (SELECT least(source_name, target_name) AS a, greatest(source_name, target_name) AS b, max(confidence) AS confidence FROM {morphisms}
  WHERE name = 'interacts_with' AND confidence >= :least GROUP BY 1, 2)
SELECT a AS source_name, b AS target_name, confidence FROM u UNION ALL SELECT b, a, confidence FROM u""",
    ("morphisms",), {"least": 0.4}, "A14: undirected pairs once, at a least score, in both directions",
)
cohort_view = Relation(
    "SELECT id, confidence FROM {typed} WHERE source_cohort = :cohort AND target_cohort = :cohort", ("typed",), {"cohort": "core"}, "B1: a cohort's objects and edges"
)
quality_counts = Relation(
    f"""SELECT count(*) AS every, count(*) FILTER (WHERE {any_of('provenance', GOLD)}) AS gold, count(*) FILTER (WHERE {any_of('provenance', SILVER)}) AS silver,
count(*) FILTER (WHERE provenance <> 'unknown') AS bronze, count(*) FILTER (WHERE confidence >= 0.7) AS high, count(*) FILTER (WHERE confidence >= 0.4) AS medium,
count(*) FILTER (WHERE confidence >= 0.2) AS low FROM {{morphisms}}""",
    ("morphisms",), {}, "B2: edges in each quality tier",
)
STRICT = f"""NOT (source_type = 'Drug' AND target_type = 'Disease')
AND NOT (source_type NOT IN ({NOT_INTERMEDIATE}) AND target_type = 'Disease' AND {any_of('provenance', BRIDGE_MARKERS)})
AND NOT contains(provenance, :without)"""
strict_view = Relation(
    f"""SELECT id, name, source_name, target_name, source_type, target_type, coalesce(nullif(confidence, 0), 1.0) AS confidence, created_at, provenance FROM {{typed}}
WHERE {STRICT}""",
    ("typed",), {"without": "ESMC"}, "B3, B5, B6, B8: no labels, no bridges made from labels, no ablated source; confidence 0 is 1",
)
held_out_view = Relation(
    """SELECT m.id FROM {morphisms} m WHERE NOT EXISTS (SELECT 1 FROM {held} h WHERE h.source_name = m.source_name AND h.target_name = m.target_name)""",
    ("morphisms", "held"), {}, "B4: edges without the held-out pairs",
)
quality_view = Relation(
    """SELECT id FROM {typed} WHERE (source_type = 'Drug' AND target_type = 'Disease') OR confidence >= :least""", ("typed",), {"least": 0.6}, "B7: quality never drops labels"
)
missing_ends = Relation(
    """SELECT e.name FROM (SELECT source_name AS name FROM {morphisms} UNION SELECT target_name FROM {morphisms}) e
WHERE NOT EXISTS (SELECT 1 FROM {objects} o WHERE o.name = e.name AND o.cohort = :cohort)""",
    ("objects", "morphisms"), {"cohort": "core"}, "B9: names used by edges that a view of the objects lacks",
)
orphan_ends = Relation(
    """WITH use AS (SELECT n.name, max(n.role) AS last_role, min(n.role) AS first_role, bool_and(n.rel IN ('activates', 'inhibits', 'modulates')) AS acts, bool_or(contains(n.provenance, 'ChEMBL:')) AS sourced
  FROM (SELECT source_name AS name, 'source' AS role, name AS rel, provenance FROM {morphisms} UNION ALL SELECT target_name, 'target', name, provenance FROM {morphisms}) n
  WHERE NOT EXISTS (SELECT 1 FROM {objects} o WHERE o.name = n.name AND o.cohort = 'core') GROUP BY n.name)
SELECT name, CASE WHEN first_role <> 'source' OR last_role <> 'source' THEN 'refused: also a target' WHEN NOT acts THEN 'refused: relation' WHEN NOT sourced THEN 'refused: no source'
  ELSE 'materialized' END AS decision FROM use""",
    GRAPH, {}, "B10: which orphan ends become drugs, and why others do not",
)
positive_labels = Relation("SELECT DISTINCT source_name, target_name FROM {typed} WHERE name = 'treats' AND source_type = 'Drug' AND target_type = 'Disease'", ("typed",), {}, "B12")
pair_universe = Relation(
    "SELECT a.name AS source_name, b.name AS target_name FROM {objects} a, {objects} b WHERE a.type_name = 'Drug' AND b.type_name = 'Disease'", ("objects",), {},
    "B13: every drug with every disease; diseases are few and Spark broadcasts them",
)
clean_subgraph = Relation(
    """SELECT m.id FROM {strict} m WHERE m.confidence >= :least AND EXISTS (SELECT 1 FROM {typed} t WHERE t.source_name = m.source_name AND t.target_name = m.target_name AND t.name = m.name)""",
    ("strict", "typed"), {"least": 0.7}, "B14: strong evidence that a view shows",
)
edges_of_type = Relation(
    "SELECT target_type, name, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM {typed} WHERE source_type = :type GROUP BY target_type, name", ("typed",), {"type": "Drug"}, "B15"
)
graph_statistics = Relation(
    """SELECT (SELECT count(*) FROM {objects}) AS objects, (SELECT count(*) FROM {morphisms}) AS morphisms, (SELECT count(DISTINCT name) FROM {morphisms}) AS relations,
(SELECT round(count(*) / ((SELECT CAST(count(*) AS DOUBLE) FROM {objects}) * ((SELECT count(*) FROM {objects}) - 1)), 8) FROM {morphisms}) AS density""",
    GRAPH, {}, "B17",
)
statistics_by_type = Relation(
    "SELECT source_type, name, target_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM {typed} GROUP BY source_type, name, target_type", ("typed",), {}, "B17 by type"
)
_last_edges = Relation(
    """SELECT source_name, target_name, source_type, target_type, max_by(confidence, concat(CAST(created_at AS STRING), id)) AS confidence,
max_by(name, concat(CAST(created_at AS STRING), id)) AS name FROM {view}
GROUP BY source_name, target_name, source_type, target_type""",
    ("view",),
)


def _dealt_last(view: DataFrame) -> DataFrame:
    """Pairs have an edge or two, so edges are dealt by their pair as they are: the sort that strings need in
    an aggregate is then of a part's rows, not of all that a task reads, and nothing twice as wide is moved."""
    return _last_edges(view.repartition("source_name", "target_name", "source_type", "target_type"))


last_edges = Stepped(
    _last_edges.sql, ("view",), {}, "the last edge of each pair, the one that a single-valued graph holds", _dealt_last,
)
