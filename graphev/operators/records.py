"""Records of reviews, receipts and articles, the legacy view and equivalence classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphev.operators.relation import Relation

legacy_objects = Relation(
    """WITH kept AS (SELECT name, type_name FROM {objects} ORDER BY birth, name LIMIT :most), ends AS (SELECT source_name AS name FROM {morphisms} UNION SELECT target_name FROM {morphisms})
SELECT coalesce(k.name, e.name) AS name, coalesce(k.type_name, 'Object') AS type_name, k.name IS NOT NULL AS listed FROM kept k FULL JOIN ends e ON e.name = k.name""",
    ("objects", "morphisms"), {"most": 100}, "B11: the first objects, and untyped ones for all other ends of edges",
)
equivalents = Relation(
    """WITH c AS (SELECT concat(p_brand, '/', p_type) AS class, concat('P', CAST(p_partkey AS STRING)) AS member FROM {part})
SELECT n.a, n.b, x.class FROM {neighbours} n JOIN c x ON x.member = n.a JOIN c y ON y.member = n.b AND y.class = x.class""",
    ("neighbours", "part"), {}, "B16: which neighbours are equivalent, and by what class; exact members, not parts of names",
)
receipts = Relation(
    """SELECT o_custkey AS receipt, o_orderkey AS seq, CASE o_orderstatus WHEN 'P' THEN '' ELSE o_orderpriority END AS title, CASE WHEN o_totalprice > 150000 THEN concat('http://o/', CAST(o_orderkey AS STRING)) ELSE '' END AS url,
CASE o_orderstatus WHEN 'O' THEN NULL ELSE o_orderkey % 2 END AS resolves FROM {orders}""",
    ("orders",), {}, "receipts in the order of their arrival",
)
upsert_receipts = Relation(
    """SELECT receipt, count(*) AS versions, coalesce(max_by(title, seq) FILTER (WHERE title <> ''), '') AS title, coalesce(max_by(url, seq) FILTER (WHERE url <> ''), '') AS url,
max_by(resolves, seq) FILTER (WHERE resolves IS NOT NULL) AS resolves FROM {receipts} GROUP BY receipt""",
    ("receipts",), {}, "A24: a newer text wins unless it is empty, a newer number unless it is null",
)
code_sheet = Relation(
    """SELECT source, target, label, CASE CAST(floor(score * 1000) AS INT) % 8 WHEN 0 THEN ' a' WHEN 1 THEN 'B' WHEN 2 THEN 'c ' WHEN 3 THEN 'D' WHEN 4 THEN 'E' WHEN 5 THEN 'F' WHEN 6 THEN NULL ELSE '' END AS code FROM {packet}""",
    ("packet",), {}, "a reviewer's codes, with blanks and mistakes",
)
answer_sheet = Relation(
    """SELECT id, name AS relation, CASE CAST(floor(confidence * 1000) AS INT) % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'partially' WHEN 2 THEN ' no' WHEN 3 THEN 'maybe' WHEN 4 THEN NULL ELSE '' END AS answer FROM {morphisms}""",
    ("morphisms",), {}, "a reviewer's answers, with blanks and mistakes",
)
packet_report = Relation(
    """WITH c AS (SELECT label, upper(trim(code)) AS code FROM {codes}), k AS (SELECT label, code FROM c WHERE code IN ('A', 'B', 'C', 'D', 'E')),
b AS (SELECT CASE WHEN relation IN ('associated_with', 'driver_of') THEN 'terminal_protein_disease' ELSE 'other' END AS layer, lower(trim(answer)) AS answer FROM {answers}), v AS (SELECT layer, answer FROM b WHERE answer IN ('yes', 'partially', 'no'))
SELECT CASE WHEN label THEN 'control' ELSE 'unlabelled' END AS section, code AS item, count(*) AS n, CAST(NULL AS DOUBLE) AS share FROM k GROUP BY label, code
UNION ALL SELECT 'gap', 'A+B', count(*) FILTER (WHERE code IN ('A', 'B')), round(count(*) FILTER (WHERE code IN ('A', 'B')) / nullif(CAST(count(*) AS DOUBLE), 0), 6) FROM k WHERE NOT label
UNION ALL SELECT 'precision', 'strict', count(*) FILTER (WHERE answer = 'yes'), round(count(*) FILTER (WHERE answer = 'yes') / nullif(CAST(count(*) AS DOUBLE), 0), 6) FROM v
UNION ALL SELECT 'precision', 'lenient', count(*) FILTER (WHERE answer <> 'no'), round(count(*) FILTER (WHERE answer <> 'no') / nullif(CAST(count(*) AS DOUBLE), 0), 6) FROM v
UNION ALL SELECT layer, answer, count(*), CAST(NULL AS DOUBLE) FROM v GROUP BY layer, answer""",
    ("codes", "answers"), {}, "E18: counts of codes, labels that are missing, how many citations hold, by layer and answer",
)


def article_text(xml: F.Column) -> F.Column:
    """All sections of an article's abstract without their tags, joined by a space; none: empty."""
    parts = F.regexp_extract_all(xml, F.lit("(?s)<AbstractText[^>]*>(.*?)</AbstractText>"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "<[^>]+>", ""))), " ")
