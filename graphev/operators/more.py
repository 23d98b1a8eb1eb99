"""Further relations: packets, holdouts, literature layers, evidence tables, markers and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphev.functions.shared import stored
from graphev.operators.paths import chains
from graphev.operators.relation import Relation, Stepped

R = Relation

walks_any = R(
    """SELECT source, length, count(*) AS n, round(sum(weight), 4) AS total FROM (SELECT f.source_name AS source, 1 AS length, f.confidence AS weight FROM {last} f WHERE f.source_type = 'Drug'
UNION ALL SELECT f.source_name, 2, f.confidence * g.confidence FROM {last} f JOIN {last} g ON f.target_name = g.source_name WHERE f.source_type = 'Drug') q GROUP BY source, length""",
    ("last",), {}, "C4: all walks of up to two edges, by source",
)
binding = R(
    """SELECT concat('S', CAST(l_suppkey AS STRING)) AS source, concat('P', CAST(l_partkey AS STRING)) AS target, round(max((0.30 * assay + 0.10 * likeness + 0.10 * fit + 0.20 * edge) / (0.10 + 0.10 + 0.20 + CASE WHEN assay > 0 THEN 0.30 ELSE 0.0 END)), 6) AS confidence
FROM (SELECT l_suppkey, l_partkey, CASE WHEN l_linestatus = 'F' THEN least(0.98, 1 / (1 + (l_quantity / 10.0) / 0.5)) ELSE 0.0 END AS assay,
  1 - 0.25 * (CASE WHEN p_retailprice > 1500 THEN 1 ELSE 0 END + CASE WHEN p_size > 40 THEN 1 ELSE 0 END) AS likeness, 0.5 + 0.2 * exp(-(p_size - 25.0) * (p_size - 25.0) / 8) AS fit, 10 * l_discount AS edge
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) q GROUP BY l_suppkey, l_partkey""",
    ("lineitem", "part"), {}, "D3, D3a, D3b, D3c: weighted mean of the components a pair has",
)
_parallel_paths = R(
    """WITH p AS (SELECT a, c, b, max(greatest(fc, gc)) AS best FROM {chains} GROUP BY a, c, b), d AS (SELECT a, c, best - lag(best) OVER (PARTITION BY a, c ORDER BY best) AS gap FROM p)
SELECT a, c, count(*) AS n, round(1 - min(gap), 6) AS score FROM d GROUP BY a, c HAVING count(*) >= 2""",
    ("chains",),
)
parallel_paths = Stepped(
    """WITH p AS (SELECT f.source_name AS a, g.target_name AS c, f.target_name AS b, max(greatest(f.confidence, g.confidence)) AS best FROM {last} f JOIN {last} g ON f.target_name = g.source_name
WHERE f.source_type = 'Drug' AND g.target_type = 'Disease' GROUP BY f.source_name, g.target_name, f.target_name),
d AS (SELECT a, c, best - lag(best) OVER (PARTITION BY a, c ORDER BY best) AS gap FROM p)
SELECT a, c, count(*) AS n, round(1 - min(gap), 6) AS score FROM d GROUP BY a, c HAVING count(*) >= 2""",
    ("last",), {}, "D14: how alike the two most alike parallel paths of a pair are; a path counts by its best edge",
    lambda last: _parallel_paths(chains(last)),
)
contradictions = R(
    """SELECT source_name, target_name, count(DISTINCT name) AS relations, bool_or(name = 'inhibits') AND bool_or(name = 'activates') AS contradicts, min(confidence) AS weakest FROM {view} WHERE source_type = 'Drug' GROUP BY source_name, target_name""",
    ("view",), {}, "D20: pairs with relations that exclude each other",
)
_best_chains = R(
    """SELECT a, c, k, b, composite FROM (SELECT *, row_number() OVER (PARTITION BY a, c ORDER BY composite DESC, b, f_name, g_name) AS k FROM (SELECT a, b, c, f_name, g_name, max(composite) AS composite FROM {horns} GROUP BY a, b, c, f_name, g_name) d) q WHERE k <= :most""",
    ("horns",), {"most": 3}, "",
)


def _leading(horns: DataFrame, most: int) -> DataFrame:
    """Chains that can be among the most best ones of their pair. Intermediates are dealt to groups; the best
    of a group is another chain for each, so that the most-th best of these is a bar that as many chains
    reach. Only those are sorted; the others are opened twice instead of being kept."""
    groups = max(16, 4 * most)
    tops = [F.max(F.when(F.pmod(F.xxhash64("b"), F.lit(groups)) == i, F.col("composite"))).alias(f"_t{i}") for i in range(groups)]
    found = F.filter(F.array(*[F.col(f"_t{i}") for i in range(groups)]), lambda x: x.isNotNull())
    bars = horns.groupBy("a", "c").agg(*tops).select(F.col("a").alias("_a"), "c", F.get(F.sort_array(found, asc=False), F.lit(most - 1)).alias("bar"))
    bars = stored(bars.filter("bar IS NOT NULL").groupBy("_a").agg(F.map_from_entries(F.collect_list(F.struct("c", "bar"))).alias("_bars")), "bars")
    rows = horns.join(bars.hint("shuffle_hash"), F.col("a") == F.col("_a"), "left")
    bar = F.element_at("_bars", F.col("c"))
    return rows.filter(bar.isNull() | (F.col("composite") >= bar)).drop("_a", "_bars")


best_chains = Stepped(
    _best_chains.sql, ("horns",), _best_chains.params, "E7: the best chains of a pair", lambda horns, most=3: _best_chains(_leading(horns, most), most=most),
)
missing_evidence = R(
    """SELECT a, c, NOT bool_or(g_name = 'driver_of') AS no_driver, bool_and(composite < 0.2) AS all_weak, NOT bool_or(f_name <> 'modulates') AS no_direction, count(*) AS chains FROM {horns} GROUP BY a, c""", ("horns",), {}, "E8"
)
standing = R(
    """SELECT a, c, CASE WHEN bool_or(g_name = 'driver_of' AND composite >= 0.3) THEN 'SUPPORTED_FOR_REVIEW' WHEN bool_or(g_name <> 'associated_with') THEN 'WEAK' ELSE 'NOT_ASSESSED' END AS standing FROM {horns} GROUP BY a, c""", ("horns",), {}, "E9"
)
base_names = R(
    """SELECT base, count(*) AS forms, max(p_retailprice) AS best FROM (SELECT regexp_replace(p_name, '( (ring|bolt|sodium|hydrochloride|citrate))+$', '') AS base, p_retailprice FROM {part}) q GROUP BY base""", ("part",), {}, "E13, M3: names without their trailing forms"
)
unfilled_horns = R("SELECT a, c, b, composite FROM {fillers} f WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.source_name = f.a AND l.target_name = f.c)", ("fillers", "labels"), {}, "E15")
packet = R(
    """SELECT target, source, label, score FROM (SELECT *, row_number() OVER (PARTITION BY target, label ORDER BY score DESC, source) AS k FROM {scores} WHERE votes > 0) q WHERE (label AND k <= :controls) OR (NOT label AND k <= :most)""",
    ("scores",), {"controls": 3, "most": 7}, "E17: known positives and the best unlabelled pairs of a disease",
)
calibrated = R(
    """WITH last AS (SELECT max(bin) AS bin, max_by(label_rate, bin) AS rate FROM {bins}), r AS (SELECT DISTINCT score FROM {scores}),
f AS (SELECT r.score, min(b.bin) AS bin, min_by(b.label_rate, b.bin) AS rate FROM r LEFT JOIN {bins} b ON r.score <= b.score_max GROUP BY r.score)
SELECT s.source, s.target, coalesce(f.rate, l.rate) AS rate, coalesce(f.bin, l.bin) AS bin FROM {scores} s JOIN f ON f.score = s.score, last l""",
    ("scores", "bins"), {}, "E19: the first bin whose maximum holds the score, else the last; bins are a handful of rows",
)
tier_confidence = R(
    """SELECT source_name, count(*) AS edges, round(sum(w * confidence) / sum(w), 6) AS weighted, round(stddev_pop(confidence), 6) AS spread, CASE WHEN avg(w) >= 0.8 THEN 'strong' WHEN avg(w) >= 0.5 THEN 'medium' ELSE 'weak' END AS strength
FROM (SELECT source_name, confidence, CASE WHEN contains(provenance, 'ChEMBL') THEN 1.0 WHEN contains(provenance, 'FDA') THEN 0.9 WHEN contains(provenance, 'STRING') THEN 0.7 ELSE 0.5 END AS w FROM {morphisms}) q GROUP BY source_name""",
    ("morphisms",), {}, "E24, E25: confidence weighted by evidence grades",
)
outcome_rates = R(
    """SELECT v.strategy, s.target, count(*) AS n, round(avg(CASE WHEN s.label THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(greatest(0.1, least(0.98, 0.5 * v.confidence + 0.25 * CASE WHEN s.label THEN 1.0 ELSE 0.0 END + 0.25))), 6) AS learnt
FROM {votes} v JOIN {scores} s ON s.source = v.source AND s.target = v.target GROUP BY v.strategy, s.target""",
    ("votes", "scores"), {}, "E27",
)
attention = R(
    """SELECT f.a, f.c, f.b, CASE WHEN s.chains <= 25 THEN 'pair' WHEN s.chains <= 50 THEN 'drug_wide' ELSE 'well_studied' END AS class, f.f_name <> 'modulates' AND s.chains <= 25 AS target_zone FROM {fillers} f JOIN {scores} s ON s.source = f.a AND s.target = f.c WHERE NOT s.label""",
    ("fillers", "scores"), {}, "E29",
)
evaluation = R("SELECT a.positives, a.negatives, a.auroc, p.auprc, m.mrr FROM {auroc} a, {auprc} p, {mrr} m", ("auroc", "auprc", "mrr"), {}, "F7: a view's metrics in one row")
leave_one_out = R(
    """SELECT l.source_name AS source, l.target_name AS target, count(o.source_name) AS peers, round(coalesce(max(least(0.70, 0.8 * o.confidence)), 0), 6) AS held_out_vote FROM {labels} l JOIN {objects} a ON a.name = l.source_name
LEFT JOIN (SELECT l.source_name, l.target_name, l.confidence, b.sector FROM {labels} l JOIN {objects} b ON b.name = l.source_name) o ON o.target_name = l.target_name AND o.source_name <> l.source_name AND o.sector = a.sector GROUP BY l.source_name, l.target_name""",
    ("labels", "objects"), {}, "F8: every label held out at once, as a column; its vote from the others",
)
holdout_candidates = R(
    """SELECT count(*) AS candidates, count(*) FILTER (WHERE label) AS positives, (SELECT count(*) FILTER (WHERE label) FROM (SELECT label FROM {scores} WHERE votes > 0 ORDER BY score DESC, source, target LIMIT 20) b) AS top_20 FROM {scores} WHERE votes > 0""", ("scores",), {}, "F11"
)
external_labels = R(
    """SELECT source_name, target_name FROM (SELECT DISTINCT a AS source_name, c AS target_name FROM {horns} WHERE composite >= 0.6) e EXCEPT SELECT source_name, target_name FROM {labels}""", ("horns", "labels"), {}, "F12, M1: external pairs that are no internal labels"
)
fold_recall = R(
    """SELECT fold, count(*) AS labels, round(avg(CASE WHEN score >= :at THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT score, k % 5 AS fold FROM {ranked_labels}) q GROUP BY fold""", ("ranked_labels",), {"at": 0.5}, "F18"
)
scrambled = R(
    """WITH t AS (SELECT count(*) AS n FROM {by_name}), n AS (SELECT source, target, score, k, n FROM {by_name}, t)
SELECT round(avg(CASE WHEN a.score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS agree, round(avg(CASE WHEN b.score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS agree_scrambled FROM n a JOIN n b ON b.k = (a.k * 7919) % a.n + 1""",
    ("by_name",), {}, "F21: the same pairs with other targets",
)
interaction_metrics = R("SELECT from_kind = to_kind AS same_kind, count(*) AS kinds, round(avg(mean_confidence), 6) AS mean_confidence FROM {motifs} GROUP BY from_kind = to_kind", ("motifs",), {}, "F25")
curvature_by_type = R("SELECT o.type_name, count(*) AS nodes, round(avg(n.kappa), 6) AS kappa, round(corr(n.kappa, o.size_value), 5) AS with_size FROM {nodes} n JOIN {objects} o ON o.name = n.node GROUP BY o.type_name", ("nodes", "objects"), {}, "F26")
_retrodiction = R(
    """WITH x AS (SELECT a, c, b, b_ends, max(composite) AS m FROM {horns} GROUP BY a, c, b, b_ends)
SELECT a, c, count(*) AS support, round(max(m), 6) AS best, round(1 - exp(sum(ln(1 - least(m, 0.999999)))), 6) AS either, round(1 - exp(sum(ln(1 - least(m * greatest(0.0, ln(26.0 / (1 + b_ends)) / ln(26.0)), 0.999999)))), 6) AS discounted
FROM x GROUP BY a, c""",
    ("horns",),
)
retrodiction = Stepped(
    """WITH d AS (SELECT b, count(DISTINCT c) AS n FROM {horns} GROUP BY b), x AS (SELECT h.a, h.c, h.b, max(h.composite) AS m FROM {horns} h GROUP BY h.a, h.c, h.b)
SELECT x.a, x.c, count(*) AS support, round(max(x.m), 6) AS best, round(1 - exp(sum(ln(1 - least(x.m, 0.999999)))), 6) AS either, round(1 - exp(sum(ln(1 - least(x.m * greatest(0.0, ln(26.0 / (1 + d.n)) / ln(26.0)), 0.999999)))), 6) AS discounted
FROM x JOIN d ON d.b = x.b GROUP BY x.a, x.c""",
    ("horns",), {}, "F27: chains over distinct intermediates, rarer ones count more; horns bring b's number of diseases", lambda horns: _retrodiction(horns),
)
numbers_in_text = R("SELECT doc_id, array_size(regexp_extract_all(text, '([0-9]+)', 1)) AS numbers, array_size(regexp_extract_all(text, '([0-9]+%)', 1)) AS rates FROM {documents}", ("documents",), {}, "G4, G5")
text_gate = R(
    """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN NOT contains(t, :one) OR NOT contains(t, :two) THEN 'REJECT' WHEN contains(t, :cue) THEN 'HOLLOW' ELSE 'AGREE' END AS verdict FROM (SELECT lower(text) AS t FROM {documents}) d) q GROUP BY verdict""",
    ("documents",), {"one": "the", "two": "and", "cue": "worthless"}, "G8, G10: texts that name both ends without a counter-cue",
)
citation_flags = R(
    """SELECT contains(provenance, 'unverified') AS unverified, contains(provenance, 'PMID') AS cited, confidence >= 0.7 AS strong, count(*) AS n FROM {morphisms} GROUP BY contains(provenance, 'unverified'), contains(provenance, 'PMID'), confidence >= 0.7""", ("morphisms",), {}, "G9, G11, G35"
)
agreement_layer = R(
    """SELECT v.source_name AS protein, v.target_name AS disease, round(least(1.0, sum(d.confidence * l.confidence)), 6) AS score FROM {last} v JOIN {last} d ON d.target_name = v.source_name AND d.source_type = 'Drug'
JOIN {labels} l ON l.source_name = d.source_name AND l.target_name = v.target_name WHERE v.target_type = 'Disease' GROUP BY v.source_name, v.target_name""",
    ("last", "labels"), {}, "G14",
)
reach_layer = R(
    """SELECT protein, disease, max(score) AS score FROM (SELECT source_name AS protein, target_name AS disease, 1.0 AS score FROM {last} WHERE target_type = 'Disease' AND confidence >= 0.8
UNION ALL SELECT i.source_name, d.target_name, 0.5 FROM {last} i JOIN {last} d ON d.source_name = i.target_name AND d.target_type = 'Disease' AND d.confidence >= 0.8 WHERE i.target_type NOT IN ('Drug', 'Disease') AND i.source_type NOT IN ('Drug', 'Disease')) q
GROUP BY protein, disease""",
    ("last",), {}, "G15: steps to a trusted edge",
)
def _peers(last: DataFrame) -> DataFrame:
    """protein, disease, peers: both ends of a link bring their list of diseases, instead of a row for each."""
    ends = last.filter("target_type = 'Disease'").groupBy("source_name").agg(F.collect_set("target_name").alias("to"))
    links = last.filter("target_type NOT IN ('Drug', 'Disease')").select(F.col("source_name").alias("protein"), F.col("target_name").alias("peer")).distinct()
    rows = links.join(ends.select(F.col("source_name").alias("peer"), F.col("to").alias("by")).hint("merge"), "peer").join(ends.select(F.col("source_name").alias("protein"), "to").hint("merge"), "protein")
    return rows.select("protein", F.explode(F.array_intersect("to", "by")).alias("disease")).groupBy("protein", "disease").agg(F.count("*").alias("peers"))


_peer_scores = R("SELECT protein, disease, peers, round(least(1.0, 0.3 * peers), 6) AS score FROM {peers}", ("peers",))
peer_layer = Stepped(
    """WITH p AS (SELECT DISTINCT a.source_name AS protein, a.target_name AS disease, b.source_name AS peer FROM {last} i JOIN {last} a ON a.source_name = i.source_name AND a.target_type = 'Disease' JOIN {last} b ON b.source_name = i.target_name AND b.target_name = a.target_name
WHERE i.target_type NOT IN ('Drug', 'Disease')) SELECT protein, disease, count(*) AS peers, round(least(1.0, 0.3 * count(*)), 6) AS score FROM p GROUP BY protein, disease""",
    ("last",), {}, "G17", lambda last: _peer_scores(_peers(last)),
)
edge_split = R(
    """SELECT CASE WHEN substring(provenance, 1, 5) = 'PMID:' AND target_type = 'Disease' AND confidence <= 0.65 THEN 'candidate' ELSE 'trusted' END AS kind, name, count(*) AS n FROM {typed} GROUP BY 1, 2""", ("typed",), {}, "G20"
)
trial_flags = R(
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'safety' WHEN o_orderpriority LIKE '2%' THEN 'efficacy' ELSE 'other' END AS reason, round(datediff(DATE '2024-01-01', CAST(o_orderdate AS DATE)) / 365.25, 4) AS years FROM {orders} WHERE o_orderstatus = 'P'""".replace("datediff(DATE '2024-01-01', CAST(o_orderdate AS DATE))", "(unix_micros(TIMESTAMP '2024-01-01 00:00:00') - unix_micros(CAST(o_orderdate AS TIMESTAMP))) / 86400000000.0"),
    ("orders",), {}, "G21, G22, M4",
)
evidence_tables = R(
    """SELECT 'studies' AS tab, count(*) AS n FROM {orders} UNION ALL SELECT 'roles', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM {lineitem}) r UNION ALL SELECT 'outcomes', count(*) FROM {lineitem} WHERE l_returnflag <> 'N'
UNION ALL SELECT 'claims', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) c UNION ALL SELECT 'receipts', count(DISTINCT ref) FROM (SELECT regexp_extract(provenance, 'PMID:([0-9]+)', 1) AS ref FROM {morphisms}) m WHERE ref <> ''""",
    ("orders", "lineitem", "morphisms"), {}, "G28, G30: rows of the evidence tables",
)
pair_evidence = R(
    """SELECT l_suppkey, c_nationkey, count(DISTINCT l_orderkey) AS studies, max(o_orderdate) AS last_study, count(*) FILTER (WHERE l_returnflag = 'A') AS positive, count(*) FILTER (WHERE l_returnflag = 'R') AS negative
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey GROUP BY l_suppkey, c_nationkey""",
    ("lineitem", "orders", "customer"), {}, "G25, G29",
)
sheet_check = R("SELECT a, c, b, CASE WHEN n = 1 THEN 'one' ELSE 'several' END AS terminal FROM (SELECT a, c, b, count(*) AS n FROM {horns} GROUP BY a, c, b) q", ("horns",), {}, "G32")
cited_share = R(
    """SELECT source_name, target_name, count(*) AS edges, round(avg(CASE WHEN contains(provenance, 'PMID') THEN 1.0 ELSE 0.0 END), 6) AS cited FROM {view} GROUP BY source_name, target_name""", ("view",), {}, "G33"
)
rewritten = R(
    """SELECT id, CASE WHEN contains(provenance, 'unverified') THEN concat(replace(provenance, 'literature (unverified); ', ''), '; [LEXICAL-COOCCURRENCE]') ELSE concat(provenance, '; [RELATION-VERIFIED]') END AS provenance FROM {typed} WHERE target_type = 'Disease' AND contains(provenance, 'PMID')""", ("typed",), {}, "G36"
)
merged = R(
    """SELECT decision, count(*) AS n FROM (SELECT CASE WHEN o.name IS NULL THEN 'no endpoint' WHEN e.s IS NOT NULL THEN 'exists' WHEN p.confidence < 0.5 THEN 'weak' ELSE 'merged' END AS decision FROM {proposed} p LEFT JOIN {objects} o ON o.name = p.source_name
LEFT JOIN (SELECT DISTINCT source_name AS s, target_name AS t FROM {view}) e ON e.s = p.source_name AND e.t = p.target_name) q GROUP BY decision""",
    ("proposed", "objects", "view"), {}, "G37, G6",
)
citation_use = R("SELECT pmid, count(*) AS edges, min(id) AS first_edge FROM {citations} GROUP BY pmid", ("citations",), {}, "G38")
compound_index = R("SELECT lower(p_name) AS name, count(*) AS ids, count(DISTINCT p_brand) AS structures, count(DISTINCT p_brand) > 1 AS ambiguous FROM {part} GROUP BY lower(p_name)", ("part",), {}, "H1")
strata = R(
    """SELECT CASE WHEN n < 3 THEN 'TOO_FEW' WHEN median_auc < 0.6 THEN 'POTENT' WHEN lineages < 3 THEN 'NARROW' WHEN n >= 30 THEN 'WELL_POWERED' ELSE 'OTHER' END AS stratum, count(*) AS compounds FROM (SELECT compound, count(*) AS n, count(DISTINCT lineage) AS lineages, median(auc) AS median_auc FROM {dose} GROUP BY compound) q GROUP BY 1""",
    ("dose",), {}, "H2",
)
four_cliques = R(
    """SELECT count(*) AS cliques FROM {triangles} a JOIN {triangles} b ON a.u = b.u AND a.v = b.v AND a.w < b.w JOIN {neighbours} n ON n.a = a.w AND n.b = b.w""", ("triangles", "neighbours"), {}, "I8: four-cliques"
)
rips_edges = R(
    """WITH c AS (SELECT cell, x, y, CAST(floor(x / :reach) AS INT) AS gx, CAST(floor(y / :reach) AS INT) AS gy FROM {cells}), o AS (VALUES (-1), (0), (1)), near AS (SELECT c.*, c.gx + ox.d AS nx, c.gy + oy.d AS ny FROM c, (SELECT * FROM o) AS ox(d), (SELECT * FROM o) AS oy(d))
SELECT a.cell AS a, b.cell AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS filtration FROM near a JOIN c b ON b.gx = a.nx AND b.gy = a.ny WHERE a.cell < b.cell AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= :reach * :reach""",
    ("cells",), {"reach": 2.0}, "I9: edges of the radius graph, over a grid",
)
marker_types = R("SELECT cell, CASE WHEN ligand >= 2 AND receptor >= 2 THEN 'dual' WHEN ligand >= 2 THEN 'sender' WHEN receptor >= 2 THEN 'receiver' ELSE 'other' END AS cell_type FROM {cells}", ("cells",), {}, "K1")
intracellular = R("SELECT cell, least(ligand, receptor) AS confidence FROM {cells} WHERE ligand >= :least AND receptor >= :least", ("cells",), {"least": 0.5}, "K3")
decoys = R(
    """SELECT from_kind, to_kind, k FROM (SELECT from_kind, to_kind, row_number() OVER (ORDER BY mean_confidence, from_kind, to_kind) AS k FROM {motifs} WHERE from_kind <> to_kind) q WHERE k <= :most""", ("motifs",), {"most": 24}, "K5"
)
spatial_coherence = R(
    """SELECT p.a, p.b, round(0.5 * p.confidence + CASE WHEN x.kind = y.kind THEN 0.3 ELSE 0.0 END, 6) AS coherence FROM {proximity} p JOIN {cells} x ON x.cell = p.a JOIN {cells} y ON y.cell = p.b""", ("proximity", "cells"), {}, "K6"
)
two_step_forecast = R(
    """SELECT first, second, round(p * 0.7, 6) AS confidence FROM (SELECT a.source AS first, b.target AS second, max((a.n / CAST(sa.n AS DOUBLE)) * (b.n / CAST(sb.n AS DOUBLE))) AS p FROM {transitions} a JOIN {transitions} b ON b.source = a.target
JOIN (SELECT source, sum(n) AS n FROM {transitions} GROUP BY source) sa ON sa.source = a.source JOIN (SELECT source, sum(n) AS n FROM {transitions} GROUP BY source) sb ON sb.source = b.source GROUP BY a.source, b.target) q""",
    ("transitions",), {}, "L5: two steps ahead, the second one less sure",
)
set_overlaps = R(
    """SELECT (SELECT count(*) FROM (SELECT source, target FROM {one} INTERSECT SELECT source, target FROM {two}) i) AS both_have, (SELECT count(*) FROM (SELECT source, target FROM {one} EXCEPT SELECT source, target FROM {two}) d) AS only_first,
(SELECT count(*) FROM (SELECT source, target FROM {one} UNION SELECT source, target FROM {two}) u) AS either""",
    ("one", "two"), {}, "M1",
)
