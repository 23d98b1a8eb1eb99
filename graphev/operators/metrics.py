"""Evaluation: ranking metrics, funnels, calibration. scores: source, target, score, label (boolean).

Ranks that need one order over all rows work on distinct scores with their counts, so that the
window over everything is as small as the number of distinct scores (they have six digits), or on
ranks: scores with their place k from a range shuffle. A fixed number of best rows is a limit.
"""

from __future__ import annotations

from graphev.functions.shared import saved
from graphev.operators.paths import chains
from graphev.operators.relation import Relation, Stepped

auroc = Relation(
    """WITH g AS (SELECT score, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM {scores} GROUP BY score),
c AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
round(CASE WHEN sum(p) = 0 OR sum(n) = 0 THEN 0.5 ELSE sum(p * (below + n / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(n)) END, 6) AS auroc FROM c""",
    ("scores",), {}, "F1",
)
auprc = Relation(
    """WITH g AS (SELECT score, count(*) FILTER (WHERE label) AS p, count(*) AS n FROM {scores} GROUP BY score),
c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT round(coalesce(sum(p * tp / CAST(seen AS DOUBLE)) / nullif(CAST(sum(p) AS DOUBLE), 0), 0), 6) AS auprc FROM c""",
    ("scores",), {}, "F2, ties as one step",
)
precision_at = Relation(
    """WITH r AS (SELECT label, row_number() OVER (ORDER BY score DESC, source, target) AS k FROM (SELECT * FROM {scores} ORDER BY score DESC, source, target LIMIT 50) b)
SELECT x.n AS at_k, count(*) FILTER (WHERE label) AS hits, round(count(*) FILTER (WHERE label) / CAST(x.n AS DOUBLE), 6) AS share FROM r JOIN (VALUES (5), (10), (20), (50)) AS x(n) ON k <= x.n GROUP BY x.n""",
    ("scores",), {}, "F3, F17",
)
mean_reciprocal_rank = Relation(
    """SELECT count(*) AS positives, round(avg(1.0 / k), 8) AS mrr FROM {ranks} WHERE label""", ("ranks",), {}, "F4"
)
funnel = Relation(
    """WITH t AS (SELECT count(*) AS n FROM {ranks}), r AS (SELECT label, k, n FROM {ranks}, t)
SELECT f.share, max(n) AS n, count(*) FILTER (WHERE label AND k <= greatest(1, floor(n * f.share))) AS captured,
round(count(*) FILTER (WHERE label AND k <= greatest(1, floor(n * f.share))) / nullif(count(*) FILTER (WHERE label) * CAST(max(f.share) AS DOUBLE), 0), 6) AS enrichment
FROM r, (VALUES (0.05), (0.1), (0.2), (0.5)) AS f(share) GROUP BY f.share""",
    ("ranks",), {}, "F13: labels in the best shares",
)
degree_baseline = Relation(
    """WITH d AS (SELECT source_name AS who, count(*) AS n FROM {view} GROUP BY source_name), e AS (SELECT target_name AS who, count(*) AS n FROM {view} GROUP BY target_name)
SELECT p.source_name AS source, p.target_name AS target, round(coalesce(d.n, 0) * coalesce(e.n, 0) / CAST(max(coalesce(d.n, 0) * coalesce(e.n, 0)) OVER () AS DOUBLE), 6) AS score
FROM {pairs} p LEFT JOIN d ON d.who = p.source_name LEFT JOIN e ON e.who = p.target_name""",
    ("view", "pairs"), {}, "F6: product of degrees",
)
_shared = Relation("SELECT a AS source, c AS target, count(DISTINCT b) AS n FROM {chains} GROUP BY a, c", ("chains",))
_by_most = Relation("SELECT source, target, n, round(n / CAST(m.most AS DOUBLE), 6) AS score FROM {shared} CROSS JOIN (SELECT max(n) AS most FROM {shared}) m", ("shared",))
common_neighbours = Stepped(
    """SELECT source, target, n, round(n / CAST(max(n) OVER () AS DOUBLE), 6) AS score FROM (SELECT f.source_name AS source, g.target_name AS target, count(DISTINCT f.target_name) AS n
FROM {view} f JOIN {view} g ON f.target_name = g.source_name WHERE f.source_type = 'Drug' AND g.target_type = 'Disease' GROUP BY f.source_name, g.target_name) q""",
    ("view",), {}, "F6: common neighbours", lambda view: _by_most(saved(_shared(chains(view)))),
)
temporal_holdout = Relation(
    """SELECT s.target, count(*) AS pairs, count(*) FILTER (WHERE s.label) AS labels, round(avg(s.score), 6) AS mean_score FROM {scores} s JOIN {objects} o ON o.name = s.source
WHERE o.birth > :cutoff GROUP BY s.target""",
    ("scores", "objects"), {"cutoff": 1950}, "F9: what is newer than a cutoff",
)
disease_holdout = Relation(
    """WITH r AS (SELECT target, label, rank() OVER (PARTITION BY target ORDER BY score) + (count(*) OVER (PARTITION BY target, score) - 1) / 2.0 AS r FROM {scores}),
f AS (SELECT target, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n, sum(CASE WHEN label THEN r ELSE 0 END) AS rs FROM r GROUP BY target)
SELECT target, p, round((rs - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n), 6) AS auroc FROM f WHERE p >= :least AND n > 0""",
    ("scores",), {"least": 2}, "F10: each disease by itself",
)
calibration_bins = Relation(
    """WITH t AS (SELECT count(*) AS n FROM {upward}), r AS (SELECT score, label, k, n FROM {upward}, t),
b AS (SELECT *, CAST(floor((k - 1) * :bins / CAST(n AS DOUBLE)) AS INT) AS bin FROM r)
SELECT bin, count(*) AS n, min(score) AS score_min, max(score) AS score_max, count(*) FILTER (WHERE label) AS positives, round(avg(score), 6) AS mean_score,
round(count(*) FILTER (WHERE label) / CAST(count(*) AS DOUBLE), 6) AS label_rate FROM b GROUP BY bin""",
    ("upward",), {"bins": 10}, "F14: bins of equal size",
)
calibration_error = Relation(
    """SELECT count(*) AS bins, round(avg(gap), 6) AS ece, round(max(gap), 6) AS mce FROM (SELECT abs(avg(score) - avg(CASE WHEN label THEN 1.0 ELSE 0.0 END)) AS gap FROM {scores}
GROUP BY least(CAST(floor(score * :bins) AS INT), :bins - 1)) q""",
    ("scores",), {"bins": 10}, "F15",
)
spearman = Relation(
    """WITH g AS (SELECT score, chains, count(*) AS n FROM {scores} GROUP BY score, chains),
a AS (SELECT score, sum(n) OVER (ORDER BY score) - (n - 1) / 2.0 AS r FROM (SELECT score, sum(n) AS n FROM g GROUP BY score) x),
b AS (SELECT chains, sum(n) OVER (ORDER BY chains) - (n - 1) / 2.0 AS r FROM (SELECT chains, sum(n) AS n FROM g GROUP BY chains) y),
m AS (SELECT g.n, CAST(a.r AS DOUBLE) AS x, CAST(b.r AS DOUBLE) AS y FROM g JOIN a ON a.score = g.score JOIN b ON b.chains = g.chains),
c AS (SELECT sum(n) AS n, sum(n * x) / sum(n) AS mx, sum(n * y) / sum(n) AS my FROM m)
SELECT CAST(max(c.n) AS BIGINT) AS n, round(sum(m.n * (x - mx) * (y - my)) / nullif(sqrt(sum(m.n * (x - mx) * (x - mx)) * sum(m.n * (y - my) * (y - my))), 0), 6) AS rho FROM m, c""",
    ("scores",), {}, "F23",
)
label_audit = Relation(
    """SELECT rule, count(*) AS rows_found FROM (SELECT 'unknown source' AS rule FROM {labels} l WHERE NOT EXISTS (SELECT 1 FROM {objects} o WHERE o.name = l.source_name AND o.type_name = 'Drug')
UNION ALL SELECT 'unknown target' FROM {labels} l WHERE NOT EXISTS (SELECT 1 FROM {objects} o WHERE o.name = l.target_name AND o.type_name = 'Disease')
UNION ALL SELECT 'label' FROM {labels}) q GROUP BY rule""",
    ("labels", "objects"), {}, "F24",
)
confusion = Relation(
    """SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / nullif(CAST(sum(tp) + sum(fp) AS DOUBLE), 0), 6) AS prec, round(sum(tp) / nullif(CAST(sum(tp) + sum(fn) AS DOUBLE), 0), 6) AS recall
FROM (SELECT CASE WHEN label AND score >= :at THEN 1 ELSE 0 END AS tp, CASE WHEN NOT label AND score >= :at THEN 1 ELSE 0 END AS fp, CASE WHEN label AND score < :at THEN 1 ELSE 0 END AS fn FROM {scores}) q""",
    ("scores",), {"at": 0.5}, "F19, F22",
)
ablation = Relation(
    """SELECT strategy AS without, count(*) AS pairs, round(avg(rest), 6) AS mean_without FROM (SELECT v.strategy, v.source, v.target, avg(o.confidence) AS rest FROM {votes} v
JOIN {votes} o ON o.source = v.source AND o.target = v.target AND o.strategy <> v.strategy GROUP BY v.strategy, v.source, v.target) q GROUP BY strategy""",
    ("votes",), {}, "F20: scores without one strategy",
)
