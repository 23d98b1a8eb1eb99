"""Evidence grades, text gates, literature filter, trial tables and search."""

from __future__ import annotations

from graphev.operators.relation import Relation

tiers = Relation(
    """SELECT tier, name, count(*) AS n FROM (SELECT name, CASE WHEN contains(p, '[EMBEDDING-INFERRED]') THEN 'INFERRED' WHEN contains(p, '[LEXICAL-COOCCURRENCE]') THEN 'SPECULATIVE'
WHEN contains(p, '[RELATION-SCREENED]') OR contains(p, 'UNVERIFIED') THEN 'HYPOTHESIS' WHEN contains(p, '[RELATION-VERIFIED]') THEN 'ESTABLISHED'
WHEN contains(p, 'CHEMBL') OR contains(p, 'IC50') OR contains(p, 'KI') OR contains(p, 'KD') OR contains(p, 'ABPP') THEN 'MEASURED'
WHEN contains(p, 'FDA') OR contains(p, 'KEGG PATHWAY') OR contains(p, 'NDA') OR contains(p, 'BLA') OR contains(p, 'WHO CLASSIFICATION') OR contains(p, 'CANCER GENE CENSUS') OR contains(p, 'COSMIC') THEN 'ESTABLISHED'
WHEN contains(p, 'ESM2') OR contains(p, 'ESM-2') OR contains(p, 'STRING PPI') OR contains(p, 'SIMILARITY') THEN 'INFERRED' ELSE 'HYPOTHESIS' END AS tier
FROM (SELECT name, upper(provenance) AS p FROM {morphisms}) q) t GROUP BY tier, name""",
    ("morphisms",), {}, "G1: the grade of an edge from its provenance, ceilings first",
)
sources = Relation(
    """SELECT source_type, validation_status, citation_status, count(*) AS n FROM (SELECT
CASE WHEN contains(p, 'fda:') THEN 'regulatory_label' WHEN contains(p, 'chembl:') THEN 'bioactivity_database' WHEN contains(p, 'esm2:') THEN 'protein_similarity_model' WHEN contains(p, 'string') THEN 'protein_interaction_database'
WHEN contains(p, 'pmid') OR contains(p, 'literature') THEN 'literature_citation' WHEN contains(p, 'via_drug') THEN 'label_derived_bridge' ELSE 'unknown_or_internal' END AS source_type,
CASE WHEN contains(p, 'fda:') THEN 'established_source' WHEN contains(p, 'chembl:') THEN 'database_record' WHEN contains(p, 'esm2:') THEN 'computational_inference' WHEN contains(p, 'string') THEN 'computational_or_database_inference'
WHEN contains(p, 'pmid') OR contains(p, 'literature') THEN 'citation_unverified' WHEN contains(p, 'via_drug') THEN 'label_derived_inference' ELSE 'unclassified' END AS validation_status,
CASE WHEN regexp_extract(p, 'pmid:?([0-9]+)', 1) <> '' THEN 'pmid_identifier_only' WHEN p <> '' AND p <> 'unknown' THEN 'non_pmid_source' ELSE 'no_source' END AS citation_status
FROM (SELECT lower(provenance) AS p FROM {morphisms}) q) t GROUP BY source_type, validation_status, citation_status""",
    ("morphisms",), {}, "G2, G34: kinds of sources",
)
citations = Relation(
    "SELECT id, regexp_extract(provenance, 'PMID:?([0-9]+)', 1) AS pmid FROM {morphisms} WHERE regexp_extract(provenance, 'PMID:?([0-9]+)', 1) <> ''", ("morphisms",), {}, "G3"
)
support = Relation(
    """SELECT name, count(*) AS pairs, median(n) AS median_n, count(*) FILTER (WHERE n = 1) AS single, count(*) FILTER (WHERE n > 1) AS multi FROM (SELECT name, source_name, target_name, count(DISTINCT provenance) AS n
FROM {morphisms} GROUP BY name, source_name, target_name) q GROUP BY name""",
    ("morphisms",), {}, "G12: how many citations support an edge",
)
witness = Relation(
    """SELECT v.source_name AS protein, v.target_name AS disease, count(DISTINCT d.source_name) AS drugs, round(least(1.0, 0.5 * count(DISTINCT d.source_name)) * max(least(d.confidence, l.confidence)), 6) AS score
FROM {last} v JOIN {last} d ON d.target_name = v.source_name AND d.source_type = 'Drug' JOIN {labels} l ON l.source_name = d.source_name AND l.target_name = v.target_name
WHERE v.target_type = 'Disease' GROUP BY v.source_name, v.target_name""",
    ("last", "labels"), {}, "G13: drugs that hit the protein and treat the disease",
)
edge_specificity = Relation(
    """SELECT source_name AS protein, count(DISTINCT target_name) AS diseases, round(1 - count(DISTINCT target_name) / CAST((SELECT count(*) FROM {objects} WHERE type_name = 'Disease') AS DOUBLE), 6) AS specificity
FROM {view} WHERE target_type = 'Disease' GROUP BY source_name""",
    ("view", "objects"), {}, "G16",
)
combined_layers = Relation(
    """SELECT protein, disease, score, CASE WHEN score >= 0.6 THEN 'AGREE' WHEN score >= 0.3 THEN 'PARTIAL' WHEN score >= 0.1 THEN 'ORPHAN' ELSE 'REJECT' END AS class,
CASE WHEN score >= 0.6 THEN 0.85 WHEN score >= 0.3 THEN 0.5 WHEN score >= 0.1 THEN 0.3 ELSE 0.0 END AS adjusted
FROM (SELECT w.protein, w.disease, round(0.6 * w.score + 0.4 * s.specificity, 6) AS score FROM {witness} w JOIN {specificity} s ON s.protein = w.protein) q""",
    ("witness", "specificity"), {}, "G18, G19: layers of an edge put together, its class and new confidence",
)
stable_ids = Relation(
    r"""SELECT concat('claim_', substring(sha2(concat(source_name, chr(31), target_name, chr(31), name), 256), 1, 20)) AS claim_id, count(*) AS n FROM {morphisms} GROUP BY source_name, target_name, name""",
    ("morphisms",), {}, "G27: ids that depend on content alone",
)
page_receipts = Relation(
    """SELECT kind, count(*) AS n, count(DISTINCT host) AS hosts FROM (SELECT CASE WHEN contains(url, 'pubmed') THEN 'PUBMED' WHEN contains(url, 'blog.') THEN 'BLOG' ELSE 'WEB' END AS kind,
regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM {pages}) q GROUP BY kind""",
    ("pages",), {}, "G26: receipts from URLs",
)
trial_summary = Relation(
    """SELECT o_custkey, count(*) AS trials, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS ongoing,
count(*) FILTER (WHERE o_orderstatus = 'P') AS stopped, max(o_orderdate) AS last_at, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'posted' WHEN bool_or(o_orderstatus = 'O') THEN 'ongoing' ELSE 'unresolved' END AS disposition
FROM {orders} GROUP BY o_custkey""",
    ("orders",), {}, "G23, G24: a pair's trials, with orders as trials",
)
terms = Relation(
    """SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, explode(split(lower(text), ' ')) AS term FROM {documents}) q WHERE length(term) > 2 GROUP BY doc_id, term""",
    ("documents",), {}, "G31: the inverted index of all documents",
)
bm25 = Relation(
    """WITH n AS (SELECT count(*) AS docs, avg(CAST(len AS DOUBLE)) AS mean FROM (SELECT doc_id, sum(tf) AS len FROM {terms} GROUP BY doc_id) q), l AS (SELECT doc_id, sum(tf) AS len FROM {terms} GROUP BY doc_id),
f AS (SELECT term, count(*) AS df FROM {terms} WHERE term IN (:one, :two) GROUP BY term)
SELECT t.doc_id, round(sum(ln(1 + (n.docs - f.df + 0.5) / (f.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.len / n.mean))), 6) AS score
FROM {terms} t JOIN f ON f.term = t.term JOIN l ON l.doc_id = t.doc_id, n GROUP BY t.doc_id HAVING count(DISTINCT t.term) = 2""",
    ("terms",), {"one": "the", "two": "with"}, "G31: documents with all of a query's terms, by BM25",
)
co_mentions = Relation(
    """SELECT a.term AS one, b.term AS two, count(*) AS documents FROM {terms} a JOIN {terms} b ON a.doc_id = b.doc_id AND a.term < b.term
WHERE a.term IN ('idiot', 'clown', 'the', 'und', 'les', 'los') AND b.term IN ('idiot', 'clown', 'the', 'und', 'les', 'los') GROUP BY a.term, b.term""",
    ("terms",), {}, "E14: documents that name both terms of a pair",
)
sentences = Relation(
    """SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE contains(lower(sentence), :term)) AS with_term, max(length(sentence)) AS longest FROM (SELECT doc_id, explode(split(replace(text, '. ', concat('.', chr(10))), chr(10))) AS sentence
FROM {documents}) q GROUP BY doc_id""",
    ("documents",), {"term": "the"}, "G7: sentences and those that name a term",
)
# --- assay tables: parts are compounds, nations of the customers are lineages -------------------
dose_response = Relation(
    """SELECT l_partkey AS compound, c_nationkey AS lineage, l_linestatus AS screen, round(0.5 + l_quantity / 100.0, 4) AS auc, round(0.3 + 8 * l_discount, 4) AS r2
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey""",
    ("lineitem", "orders", "customer"), {}, "A17",
)
quality_gate = Relation("SELECT compound, lineage, screen, auc FROM {dose} WHERE r2 >= :floor AND auc IS NOT NULL", ("dose",), {"floor": 0.5}, "H3")
selected_screen = Relation(
    """SELECT d.* FROM {gated} d JOIN (SELECT compound, min(CASE screen WHEN 'O' THEN 0 ELSE 1 END) AS best FROM {gated} GROUP BY compound) b
ON b.compound = d.compound AND b.best = CASE d.screen WHEN 'O' THEN 0 ELSE 1 END""",
    ("gated",), {}, "H4: the preferred screen a compound has",
)
selectivity = Relation(
    """SELECT compound, count(*) AS n, round(median(auc) FILTER (WHERE lineage < :lineages), 6) AS target_median, round(median(auc) FILTER (WHERE lineage >= :lineages), 6) AS other_median,
round(median(auc) FILTER (WHERE lineage >= :lineages) - median(auc) FILTER (WHERE lineage < :lineages), 6) AS delta, median(auc) < 0.8 AS cytotoxic FROM {screened} GROUP BY compound""",
    ("screened",), {"lineages": 5}, "H5, H6",
)
#: Two-sided tail of the normal distribution at z > 0, 1 below: the complementary error function at
#: z / sqrt(2) by Chebyshev's series, to a relative 1.2e-7 everywhere (fixed values, constant first).
TAIL = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def tail(z: str) -> str:
    t = f"(1 / (1 + 0.5 * ({z}) / sqrt(2)))"
    inner = repr(TAIL[-1])
    for c in reversed(TAIL[:-1]):
        inner = f"({c!r} + {t} * {inner})"
    return f"CASE WHEN {z} <= 0 THEN 1.0 ELSE least(1.0, {t} * exp(-({z}) * ({z}) / 2 + {inner})) END"


rank_test = Relation(
    f"""WITH r AS (SELECT compound, lineage < :lineages AS inside, rank() OVER (PARTITION BY compound ORDER BY auc) + (count(*) OVER (PARTITION BY compound, auc) - 1) / 2.0 AS r,
1.0 * count(*) OVER (PARTITION BY compound, auc) AS t FROM {{screened}}),
s AS (SELECT compound, CAST(count(*) FILTER (WHERE inside) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE NOT inside) AS DOUBLE) AS n2, sum(CASE WHEN inside THEN r ELSE 0 END) AS rs, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY compound),
u AS (SELECT compound, rs - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 2 AS mean, n1 * n2 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) / 12 AS variance FROM s WHERE n1 >= 2 AND n2 >= 2),
z AS (SELECT compound, u, CASE WHEN variance > 0.000000001 THEN (abs(u - mean) - 0.5) / sqrt(variance) ELSE 0.0 END AS z FROM u)
SELECT compound, round(u, 4) AS u, round(z, 6) AS z, round({tail("z")}, 10) AS p FROM z""",
    ("screened",), {"lineages": 5}, "H7: U, its z with correction for ties and continuity, and the two-sided p (1 where all values are tied)",
)
step_up = Relation(
    """WITH r AS (SELECT compound, p, row_number() OVER (ORDER BY p, compound) AS k, count(*) OVER () AS n FROM {tests})
SELECT compound, p, round(least(1.0, min(p * n / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS q FROM r""",
    ("tests",), {}, "H8: step-up adjustment; tests: compound, p, one row per compound",
)
verdicts = Relation(
    """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN s.n < 5 THEN 'NOT_SCORABLE' WHEN q.q IS NULL THEN 'UNTESTED' WHEN q.q < 0.05 AND s.delta > 0 THEN 'SELECTIVE' WHEN s.cytotoxic THEN 'CYTOTOXIC' ELSE 'NOT_SELECTIVE' END AS verdict
FROM {selectivity} s LEFT JOIN {adjusted} q ON q.compound = s.compound) t GROUP BY verdict""",
    ("selectivity", "adjusted"), {}, "H9",
)
