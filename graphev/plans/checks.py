"""DuckDB statements written from an operator's definition, by another way than the operator's own.

They use the shared nodes of the catalogue (n_...) and replace the operator's translated statement,
so that a wrong formula does not agree with itself. Most compare pairs, which small tables allow.
"""

from __future__ import annotations

from graphev.operators.evidence import tail

#: name: nodes it reads, statement
CHECKS: dict[str, tuple[tuple[str, ...], str]] = {
    "c18_gap_fillers": (
        ("last", "labels_"),
        """WITH RECURSIVE p AS (SELECT source_name AS source, [source_name, target_name] AS seen, name AS relation, target_name AS node, target_type AS kind, confidence AS w, 1 AS len FROM n_last WHERE source_type = 'Drug'
UNION ALL SELECT p.source, list_append(p.seen, e.target_name), p.relation, e.target_name, e.target_type, p.w * e.confidence, p.len + 1 FROM p JOIN n_last e ON e.source_name = p.node
WHERE p.len < 4 AND p.kind <> 'Disease' AND NOT list_contains(p.seen, e.target_name) AND p.w * e.confidence >= 0.4),
best AS (SELECT source, node AS target, relation, max(w * [0.0, 0.9, 0.7, 0.5][len]::DOUBLE) AS c FROM p WHERE kind = 'Disease' AND len >= 2 GROUP BY 1, 2, 3)
SELECT source, target, relation, round(c, 6) AS confidence FROM best ANTI JOIN (SELECT source_name AS source, target_name AS target FROM n_labels_ UNION SELECT source_name, target_name FROM n_last) l USING (source, target) WHERE c >= 0.4""",
    ),
    "m11_path_weights": (
        ("last",),
        """SELECT d.source_name AS source, t.target_name AS target, round(max(d.confidence * t.confidence), 6) AS product, round(min(d.confidence + t.confidence), 6) AS sum,
round(max(CASE WHEN d.confidence < t.confidence THEN d.confidence ELSE t.confidence END), 6) AS widest, max(CASE WHEN d.confidence > 0 AND t.confidence > 0 THEN 1 ELSE 0 END)::DOUBLE AS reach,
round(max(CASE WHEN d.confidence + t.confidence > 1 THEN d.confidence + t.confidence - 1 ELSE 0 END), 6)::DOUBLE AS clipped
FROM n_last d JOIN n_last t ON t.source_name = d.target_name WHERE d.source_type = 'Drug' AND t.target_type = 'Disease' GROUP BY 1, 2""",
    ),
    "i14_reaches": (
        ("strict",),
        """WITH RECURSIVE r(node, k) AS (SELECT DISTINCT source_name, 1 FROM n_strict WHERE target_type = 'Disease'
UNION SELECT v.source_name, r.k + 1 FROM r JOIN n_strict v ON v.target_name = r.node WHERE r.k < 4) SELECT node, min(k)::INTEGER AS steps FROM r GROUP BY node""",
    ),
    "a24_receipts": (
        ("receipts",),
        """SELECT receipt, count(*) AS versions, coalesce(list_last(list(title ORDER BY seq) FILTER (WHERE title <> '')), '') AS title, coalesce(list_last(list(url ORDER BY seq) FILTER (WHERE url <> '')), '') AS url,
list_last(list(resolves ORDER BY seq) FILTER (WHERE resolves IS NOT NULL)) AS resolves FROM n_receipts GROUP BY receipt""",
    ),
    "b11_legacy_objects": (
        ("objects", "morphisms"),
        """WITH k AS (SELECT name, type_name FROM n_objects QUALIFY row_number() OVER (ORDER BY birth, name) <= 100)
SELECT name, type_name, true AS listed FROM k UNION ALL SELECT DISTINCT name, 'Object', false FROM (SELECT unnest([source_name, target_name]) AS name FROM n_morphisms) WHERE name NOT IN (SELECT name FROM k)""",
    ),
    "b16_equivalents": (
        ("neighbours",),
        """WITH c AS (SELECT p_brand || '/' || p_type AS class, list('P' || p_partkey) AS members FROM part GROUP BY 1) SELECT n.a, n.b, c.class FROM n_neighbours n, c WHERE list_contains(c.members, n.a) AND list_contains(c.members, n.b)""",
    ),
    "a5_works": (
        (),
        """SELECT 'W' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id WHEN doc_id % 4 = 1 THEN 'Name ' || doc_id ELSE 'W' || doc_id END AS title, CASE WHEN doc_id % 7 > 0 THEN (1990 + doc_id % 40)::INTEGER END AS year,
sha256(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), ' ')) AS abstract_sha256, source AS authors, lang || ' ' || source AS concepts,
CASE WHEN doc_id % 3 > 0 THEN 'W' || doc_id * 2 || '|W' || (doc_id + 1) ELSE '' END AS citations FROM documents WHERE doc_id % 7 = 0 OR doc_id % 40 >= 10""",
    ),
    "a7_concepts": (
        (),
        """SELECT DISTINCT lang AS id, lang AS name, 0 AS level, '' AS parents, 'nowhere' AS related FROM documents UNION ALL SELECT DISTINCT lang || '_' || source, lang || ' ' || source, 1, lang, 'en_' || source FROM documents""",
    ),
    "a8_work_edges": (
        (),
        """WITH d AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 7 > 0 THEN (1990 + doc_id % 40)::INTEGER END AS year FROM documents)
SELECT 'cites' AS name, 'W' || d.doc_id AS source_name, 'W' || t.doc_id AS target_name, d.year FROM d JOIN d t ON (t.doc_id = d.doc_id * 2 OR t.doc_id = d.doc_id + 1) WHERE d.doc_id % 3 > 0 AND d.doc_id <> 1
UNION ALL SELECT 'cites', 'W1', 'W' || t.doc_id, d.year FROM d, d t, range(2) WHERE d.doc_id = 1 AND t.doc_id = 2
UNION ALL SELECT 'about', 'W' || doc_id, lower(lang || '_' || source), NULL FROM d WHERE doc_id % 3 = 0
UNION ALL SELECT DISTINCT 'subfield_of', lang || '_' || source, lang, NULL FROM d
UNION ALL SELECT DISTINCT 'related_to', lang || '_' || source, 'en_' || source, NULL FROM d WHERE source IN (SELECT source FROM d WHERE lang = 'en')""",
    ),
    "a20_signed_edges": (
        ("strict",),
        """SELECT source_name AS source, target_name AS target, CASE name WHEN 'inhibits' THEN -1 ELSE 1 END AS sign FROM n_strict WHERE name IN ('activates', 'inhibits', 'driver_of')""",
    ),
    "a22_articles": ((), """SELECT doc_id, sha256(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(replace(replace(x, '<', ''), '>', ''))), ' ')) AS abstract_sha256 FROM documents"""),
    "d17b_combined": (
        ("votes", "horns"),
        """WITH s AS (SELECT source || '>' || target AS pair, confidence * CASE strategy WHEN 'composition' THEN 0.9 ELSE 0.6 END AS yes, 0.0 AS no FROM n_votes
UNION ALL SELECT a || '>' || c, 0.0, 0.8 * 0.5 * avg(CASE f_name WHEN 'modulates' THEN 1.0 ELSE 0.0 END) FROM n_horns GROUP BY a, c),
j AS (SELECT pair, 1 - product(1 - yes) AS yes, 1 - product(1 - no) AS no FROM s GROUP BY pair),
m AS (SELECT pair, yes * no AS k, unnest([1, 2, 3]) AS subset, unnest([yes * (1 - no), no * (1 - yes), (1 - yes) * (1 - no)]) AS x FROM j)
SELECT pair, subset, round(x / (1 - k), 6) AS mass, round(k, 6) AS conflict FROM m WHERE x > 1e-12""",
    ),
    "f11_holdout_candidates": (
        ("scores",),
        """SELECT count(*) AS candidates, count(*) FILTER (WHERE label) AS positives, count(*) FILTER (WHERE label AND k <= 20) AS top_20
FROM (SELECT label, row_number() OVER (ORDER BY score DESC, source, target) AS k FROM n_scores WHERE votes > 0)""",
    ),
    "f23_spearman": (
        ("scores",),
        """WITH r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS a, rank() OVER (ORDER BY chains) + (count(*) OVER (PARTITION BY chains) - 1) / 2 AS b FROM n_scores)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""",
    ),
    "d2_pathway_support": (
        ("strict",),
        """SELECT source, target, round(1e-11 + CASE WHEN m * g > 0.85 THEN 0.85 ELSE m * g END, 6) AS confidence FROM (SELECT source, target, list_sum(l) / len(l) AS m, CASE WHEN len(l) >= 5 THEN 1.4 ELSE 0.9 + len(l) / 10.0 END AS g
FROM (SELECT a.source_name AS source, b.target_name AS target, list(a.confidence * b.confidence) AS l FROM n_strict a, n_strict b WHERE b.source_name = a.target_name AND a.source_type = 'Drug' AND b.target_type = 'Disease'
AND a.target_type <> 'Drug' AND a.target_type <> 'Disease' GROUP BY ALL))""",
    ),
    "d14_parallel_paths": (
        ("last",),
        """WITH p AS (SELECT a.source_name AS a, b.target_name AS c, a.target_name AS b, list_max(list_concat(list(a.confidence), list(b.confidence))) AS best FROM n_last a JOIN n_last b ON a.target_name = b.source_name
AND a.source_type = 'Drug' AND b.target_type = 'Disease' GROUP BY ALL)
SELECT x.a, x.c, count(DISTINCT x.b) + 1 AS n, round(max(1 - abs(x.best - y.best)), 6) AS score FROM p x JOIN p y ON x.a = y.a AND x.c = y.c AND x.b < y.b GROUP BY x.a, x.c""",
    ),
    "d17_belief": (
        ("votes",),
        """SELECT source, target, count(confidence) AS sources, round(1e-11 + 1 - product(1 - confidence), 6) AS belief, 1.0 AS plausibility, round(1e-11 + (1 - product(1 - confidence)) + 0.5 * (1 - (1 - product(1 - confidence))), 6) AS pignistic
FROM n_votes GROUP BY source, target HAVING count(*) FILTER (WHERE confidence >= 0.3) > 0""",
    ),
    "e19_calibrated": (
        ("scores", "f14_calibration_bins"),
        """SELECT s.source, s.target, coalesce((SELECT arg_min(b.label_rate, b.bin) FROM n_f14_calibration_bins b WHERE b.score_max >= s.score), (SELECT arg_max(label_rate, bin) FROM n_f14_calibration_bins)) AS rate,
coalesce((SELECT min(b.bin) FROM n_f14_calibration_bins b WHERE b.score_max >= s.score), (SELECT max(bin) FROM n_f14_calibration_bins)) AS bin FROM n_scores s""",
    ),
    "e26_evidence_odds": (
        ("votes",),
        "SELECT source, target, round(1e-11 + o / (1 + o), 8) AS posterior FROM (SELECT source, target, 0.001 / 0.999 * product(1 + confidence) AS o FROM n_votes GROUP BY ALL)",
    ),
    "f1_auroc": (
        ("scores",),
        """WITH p AS (SELECT score FROM n_scores WHERE label), n AS (SELECT score FROM n_scores WHERE NOT label)
SELECT (SELECT count(*) FROM p) AS positives, (SELECT count(*) FROM n) AS negatives, round(coalesce((SELECT avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) FROM p, n), 0.5), 6) AS auroc""",
    ),
    "f2_auprc": (
        ("scores",),
        """SELECT round(coalesce(avg((SELECT count(*) FILTER (WHERE o.label) / count(*)::DOUBLE FROM n_scores o WHERE o.score >= s.score)), 0), 6) AS auprc FROM n_scores s WHERE s.label""",
    ),
    "f4_mean_reciprocal_rank": (
        ("scores",),
        """SELECT count(*) AS positives, round(avg(1.0 / k), 8) AS mrr FROM (SELECT (SELECT count(*) + 1 FROM n_scores o WHERE o.score > s.score OR (o.score = s.score AND (o.source, o.target) < (s.source, s.target))) AS k FROM n_scores s WHERE s.label)""",
    ),
    "f10_disease_holdout": (
        ("scores",),
        """SELECT p.target, count(DISTINCT p.source) AS p, round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auroc FROM n_scores p JOIN n_scores n ON n.target = p.target AND p.label AND NOT n.label
GROUP BY p.target HAVING count(DISTINCT p.source) >= 2""",
    ),
    "f19_confusion": (
        ("scores",),
        """SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS prec, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM (SELECT count(*) FILTER (WHERE label AND score >= 0.5) AS tp,
count(*) FILTER (WHERE NOT label AND score >= 0.5) AS fp, count(*) FILTER (WHERE label AND score < 0.5) AS fn FROM n_scores)""",
    ),
    "h7_rank_test": (
        ("screened",),
        f"""WITH v AS (SELECT compound, lineage < 5 AS inside, auc FROM n_screened),
u AS (SELECT a.compound, sum(CASE WHEN a.auc > b.auc THEN 1.0 WHEN a.auc = b.auc THEN 0.5 ELSE 0 END) AS u FROM v a JOIN v b ON a.compound = b.compound AND a.inside AND NOT b.inside GROUP BY a.compound),
t AS (SELECT compound, sum(n * n * n - n) AS ties FROM (SELECT compound, auc, count(*)::DOUBLE AS n FROM v GROUP BY ALL) GROUP BY compound),
c AS (SELECT compound, count(*) FILTER (WHERE inside)::DOUBLE AS m, count(*) FILTER (WHERE NOT inside)::DOUBLE AS n, count(*)::DOUBLE AS every FROM v GROUP BY compound),
z AS (SELECT compound, u, CASE WHEN m * n / 12 * (every + 1 - ties / (every * every - every)) > 1e-9 THEN (abs(u - m * n / 2) - 0.5) / sqrt(m * n / 12 * (every + 1 - ties / (every * every - every))) ELSE 0 END AS z
FROM u JOIN t USING (compound) JOIN c USING (compound) WHERE m >= 2 AND n >= 2)
SELECT compound, round(u, 4) AS u, round(z + 1e-11, 6) AS z, round({tail("z")} + 1e-11, 10) AS p FROM z""",
    ),
    "h8_step_up": (
        ("h7_rank_test",),
        """WITH r AS (SELECT compound, p, row_number() OVER (ORDER BY p, compound) AS k FROM n_h7_rank_test)
SELECT a.compound, a.p, round(1e-11 + min(CASE WHEN b.p * t.n / b.k > 1 THEN 1.0 ELSE b.p * t.n / b.k END), 8) AS q FROM r a JOIN r b ON b.k >= a.k, (SELECT count(*) AS n FROM r) t GROUP BY a.compound, a.p""",
    ),
    "i12_signed_spread": (
        ("strict",),
        """WITH e AS (SELECT m.source_name AS s, m.target_name AS t, CASE WHEN m.name = 'inhibits' THEN -1.0 ELSE 1.0 END / d.n AS w FROM n_strict m JOIN (SELECT source_name, count(*) AS n FROM n_strict WHERE name <> 'modulates' GROUP BY ALL) d USING (source_name) WHERE m.name <> 'modulates'),
m1 AS (SELECT s, t, sum(w) AS w FROM e GROUP BY ALL), m2 AS (SELECT a.s, b.t, sum(a.w * b.w) AS w FROM m1 a JOIN m1 b ON a.t = b.s GROUP BY ALL),
d1 AS (SELECT * FROM m1 WHERE s LIKE 'S%'), d2 AS (SELECT * FROM m2 WHERE s LIKE 'S%'),
every AS (SELECT s, t, w / 2 AS w FROM d1 UNION ALL SELECT s, t, w / 4 FROM d2 UNION ALL SELECT d1.s, m2.t, d1.w * m2.w / 8 FROM d1 JOIN m2 ON d1.t = m2.s UNION ALL SELECT d2.s, m2.t, d2.w * m2.w / 16 FROM d2 JOIN m2 ON d2.t = m2.s)
SELECT s AS drug, t AS node, round(1e-11 + sum(w), 8) AS total FROM every WHERE t LIKE 'N%' GROUP BY s, t""",
    ),
    "c5_semiring_weights": (
        ("last",),
        """SELECT source, target, round(1e-11 + max(a * b), 6) AS product_best, round(1e-11 + max(a + b), 6) AS sum_best, round(1e-11 + max(a + b - a * b), 6) AS either_best,
round(1e-11 + max(CASE WHEN a > b THEN a ELSE b END), 6) AS max_best, round(1e-11 + max(CASE WHEN a > b THEN b ELSE a END), 6) AS min_best
FROM (SELECT f.source_name AS source, g.target_name AS target, f.confidence AS a, g.confidence AS b FROM n_last f, n_last g WHERE f.target_name = g.source_name AND f.source_type = 'Drug' AND g.target_type = 'Disease') GROUP BY ALL""",
    ),
    "c9_invertible_pairs": (
        ("morphisms",),
        "SELECT source_name AS a, target_name AS b FROM n_morphisms WHERE source_name < target_name INTERSECT SELECT target_name, source_name FROM n_morphisms",
    ),
    "c10_conflicts": (
        ("horns",),
        """SELECT a, c, len(l) AS chains, list_max(l) AS high, list_min(l) AS low, round(1e-11 + list_max(l) - list_min(l), 4) AS spread FROM (SELECT a, c, list(composite) AS l FROM n_horns GROUP BY ALL)
WHERE len(l) > 1 AND list_max(l) >= 0.5 AND list_min(l) <= 0.2""",
    ),
    "c16_recoverable": (
        ("labels_", "horns"),
        "SELECT (SELECT count(*) FROM n_labels_) AS labels, (SELECT count(*) FROM n_labels_ l SEMI JOIN n_horns h ON h.a = l.source_name AND h.c = l.target_name) AS recoverable",
    ),
    "c17_reachable_share": (
        ("pairs", "horns"),
        """SELECT pairs, reached, round(1e-11 + reached / pairs, 6) AS share FROM (SELECT (SELECT count(*) FROM n_pairs) AS pairs, (SELECT count(*) FROM n_pairs p SEMI JOIN n_horns h ON h.a = p.source_name AND h.c = p.target_name) AS reached)""",
    ),
    "d21_agreement": (
        ("votes",),
        """SELECT v.source, v.target, v.strategy, round(1e-11 + CASE WHEN o.n = 1 THEN 0.8 * v.confidence WHEN v.confidence + least(0.15, 0.05 * o.n) > 0.98 THEN 0.98 ELSE v.confidence + least(0.15, 0.05 * o.n) END, 6) AS adjusted
FROM n_votes v JOIN (SELECT source, target, count(*) AS n FROM n_votes GROUP BY ALL) o USING (source, target)""",
    ),
    "e3_triage": (
        ("scores",),
        """SELECT s.target, 1 + (SELECT count(*) FROM n_scores o WHERE o.target = s.target AND (o.score > s.score OR (o.score = s.score AND o.source < s.source)))::INT AS k, s.source, s.score, s.chains,
if(s.label, 'APPROVED', 'NOT_APPROVED') AS status FROM n_scores s WHERE k <= 10""",
    ),
    "e4_triage_by_drug": (
        ("scores",),
        """SELECT s.source, 1 + (SELECT count(*) FROM n_scores o WHERE o.source = s.source AND (o.score > s.score OR (o.score = s.score AND o.target < s.target)))::INT AS k, s.target, s.score FROM n_scores s WHERE k <= 10""",
    ),
    "e21_chain_aggregates": (
        ("horns",),
        """SELECT a, c, list_max(l) AS best, round(1e-11 + 1 - list_reduce(list_transform(l, lambda x: 1 - x), lambda p, q: p * q), 6) AS noisy_or,
round(1e-11 + list_max(l) + 0.3 * (1 - list_max(l)) * (exp(2 * (list_sum(l) - 1)) - 1) / (exp(2 * (list_sum(l) - 1)) + 1), 6) AS corroborated, round(1e-11 + 2 / (2 + ln(len(l))), 6) AS promiscuity
FROM (SELECT a, c, list(composite) AS l FROM n_horns GROUP BY ALL)""",
    ),
    "f3_precision_at": (
        ("scores",),
        """WITH k AS (SELECT label, (SELECT count(*) + 1 FROM n_scores o WHERE o.score > s.score OR (o.score = s.score AND (o.source, o.target) < (s.source, s.target))) AS k FROM n_scores s)
SELECT n::INT AS at_k, (SELECT count(*) FROM k WHERE label AND k <= n) AS hits, round(1e-11 + (SELECT count(*) FROM k WHERE label AND k <= n) / n, 6) AS share FROM unnest([5, 10, 20, 50]) t(n)""",
    ),
    "f13_funnel": (
        ("scores",),
        """WITH k AS (SELECT label, (SELECT count(*) + 1 FROM n_scores o WHERE o.score > s.score OR (o.score = s.score AND (o.source, o.target) < (s.source, s.target))) AS k FROM n_scores s), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE label) AS p FROM n_scores)
SELECT x.share, t.n, (SELECT count(*) FROM k WHERE label AND k <= greatest(1, floor(t.n * x.share))) AS captured,
round(1e-11 + (SELECT count(*) FROM k WHERE label AND k <= greatest(1, floor(t.n * x.share))) / (t.p * x.share), 6) AS enrichment FROM t, (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.5]) AS share) x""",
    ),
}

#: All pairs of the stated queries with all vectors, by brute force.
PAIRS = """v AS (SELECT vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, greatest(sqrt(list_dot_product(e, e)), 1e-12) AS n FROM v),
p AS MATERIALIZED (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.e, d.e) / (q.n * d.n), 6) AS similarity FROM n q JOIN n d ON q.vec_id % 100 = 0)"""
APART = "SELECT * FROM p WHERE query_id <> vec_id"
#: name: nodes it reads, common table expressions and statement
VECTOR_CHECKS: dict[str, tuple[tuple[str, ...], str]] = {
    "j1_cosine_top_k": ((), f"{PAIRS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS k FROM ({APART})) WHERE k <= 10"),
    "j2_similarities": ((), f"{PAIRS} {APART}"),
    "j3_analogies": (
        (),
        """v AS (SELECT vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS e FROM embeddings),
t AS (SELECT a.vec_id AS query_id, list_transform(range(1, len(a.e) + 1), lambda i: b.e[i] - a.e[i] + c.e[i]) AS e FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2),
s AS (SELECT t.query_id, v.vec_id, round(list_cosine_similarity(t.e, v.e), 6) AS similarity FROM t, v)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS k FROM s) WHERE k <= 5""",
    ),
    "j4_gaps": (
        ("neighbours",),
        f"""{PAIRS}, f AS ({APART} AND similarity < 0.3 AND NOT EXISTS (SELECT 1 FROM n_neighbours x WHERE (x.a = 'P' || query_id AND x.b = 'P' || vec_id) OR (x.b = 'P' || query_id AND x.a = 'P' || vec_id)))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity, vec_id) AS k FROM f) WHERE k <= 10""",
    ),
    "j6_transfer_edges": (
        ("strict",),
        f"""{PAIRS}, known AS (SELECT DISTINCT source_name AS part, target_name AS disease FROM n_strict WHERE name = 'driver_of'),
c AS (SELECT k.disease, p.vec_id, p.similarity, p.query_id AS reference, row_number() OVER (PARTITION BY k.disease, p.vec_id ORDER BY p.similarity DESC, p.query_id) AS r
FROM p JOIN known k ON k.part = 'P' || p.query_id WHERE p.query_id <> p.vec_id AND p.similarity >= 0.2 AND NOT EXISTS (SELECT 1 FROM known o WHERE o.part = 'P' || p.vec_id AND o.disease = k.disease))
SELECT * FROM (SELECT disease, vec_id, similarity, reference, row_number() OVER (PARTITION BY disease ORDER BY similarity DESC, vec_id) AS k FROM c WHERE r = 1) WHERE k <= 10""",
    ),
    "d9_similarity_votes": (
        ("neighbours",),
        f"""{PAIRS}, e AS (SELECT substr(a, 2)::BIGINT AS a, substr(b, 2)::BIGINT AS b FROM n_neighbours),
w AS (SELECT query_id AS source, vec_id AS target, 'related_to' AS relation, 'direct' AS kind, least(0.85, similarity) AS confidence FROM ({APART} AND similarity > 0.2)
UNION ALL SELECT query_id, e.b, 'interacts_with', 'through', round(least(0.85, max(0.9 * similarity)), 6) FROM ({APART} AND similarity > 0.25) s JOIN e ON e.a = s.vec_id AND e.b <> s.query_id GROUP BY query_id, e.b)
SELECT source, target, relation, kind, confidence::DOUBLE AS confidence FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = w.source AND e.b = w.target)""",
    ),
    "e20_family_classes": (
        ("strict", "labels_", "horns"),
        f"""{PAIRS}, t AS (SELECT DISTINCT source_name AS drug, target_name AS part FROM n_strict WHERE source_type = 'Drug'), l AS (SELECT DISTINCT source_name AS drug, target_name AS disease FROM n_labels_),
pos AS (SELECT 'P' || query_id AS x, 'P' || vec_id AS y, similarity FROM p WHERE similarity > 0),
m AS (SELECT d.drug, l.disease, max(pos.similarity) AS s FROM t d JOIN pos ON pos.x = d.part JOIN t r ON r.part = pos.y JOIN l ON l.drug = r.drug AND l.drug <> d.drug GROUP BY 1, 2)
SELECT h.drug, h.disease, CASE WHEN NOT EXISTS (SELECT 1 FROM l WHERE l.disease = h.disease AND l.drug <> h.drug) THEN 'No Reference' WHEN coalesce(s, 0) >= 0.3 THEN 'Family Extrapolation' WHEN coalesce(s, 0) >= 0.2 THEN 'Cross-Family Related' ELSE 'Cross-Family Novel' END AS class,
coalesce(s, 0)::DOUBLE AS similarity FROM (SELECT DISTINCT a AS drug, c AS disease FROM n_horns) h LEFT JOIN m ON m.drug = h.drug AND m.disease = h.disease""",
    ),
}
