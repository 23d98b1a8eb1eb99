"""DuckDB SQL for the queries that SQL can express. Each repeats the rule in words of SQL, over
whole tables; none of it is shared with the Spark code but the fixed rules and constants."""

from __future__ import annotations

from graphev.llm import chat_format, url_filter

BLANK_SET = r"[\x20\x09-\x0D]"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_filter_sql(rounds: int = url_filter.ROUNDS, damping: float = url_filter.DAMPING) -> str:
    rules = ", ".join(f"('{r[: r.index('/')]}', '{r[r.index('/') :]}', '{r}', '{v}')" for r, v in url_filter.RULES)
    url, link = url_filter.URL, url_filter.LINK.replace("'", "''")
    ctes = [
        f"rules(rule_host, rule_path, rule, rule_verdict) AS (VALUES {rules})",
        f"p AS (SELECT row_number() OVER () AS rid, page_id, html, translate(coalesce(regexp_extract(url, '{url}', 1), ''), '{UP}', '{LOW}') AS host,"
        f" coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages)",
        "m AS (SELECT rid, rule, rule_verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, length(rule_host) DESC, rule_verdict DESC) AS k FROM p, rules"
        " WHERE host <> '' AND (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))",
        "ruled AS (SELECT p.rid, page_id, host, path, rule, rule_verdict FROM p LEFT JOIN m ON p.rid = m.rid AND k = 1)",
        "c AS (SELECT host, sum(CASE WHEN rule_verdict = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS good, sum(CASE WHEN rule_verdict = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS bad"
        " FROM ruled WHERE rule IS NOT NULL GROUP BY host)",
        "s AS (SELECT host, good / greatest((SELECT sum(good) FROM c), 1) AS good, bad / greatest((SELECT sum(bad) FROM c), 1) AS bad FROM c)",
        f"l0 AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UP}', '{LOW}') AS dst FROM p WHERE html IS NOT NULL)",
        "l AS (SELECT src, dst, count(*)::DOUBLE AS n FROM l0 WHERE src <> '' AND src <> dst GROUP BY src, dst)",
        "f AS (SELECT src AS host, dst AS \"to\", n / sum(n) OVER (PARTITION BY src) AS wt, 0.0::DOUBLE AS wd FROM l"
        " UNION ALL SELECT dst, src, 0.0::DOUBLE, n / sum(n) OVER (PARTITION BY dst) FROM l)",
        "n AS (SELECT host, sum(good) AS good, sum(bad) AS bad FROM (SELECT host, good, bad FROM s UNION ALL SELECT DISTINCT host, 0.0::DOUBLE, 0.0::DOUBLE FROM f) GROUP BY host)",
        "r0 AS (SELECT host, good AS t, bad AS d FROM n)",
    ]
    for i in range(rounds):
        ctes += [
            f"g{i} AS MATERIALIZED (SELECT f.\"to\" AS host, sum(t * wt) AS t, sum(d * wd) AS d FROM f JOIN r{i} USING (host) GROUP BY f.\"to\")",
            f"r{i + 1} AS MATERIALIZED (SELECT n.host, {1 - damping} * good + {damping} * coalesce(g{i}.t, 0) AS t, {1 - damping} * bad + {damping} * coalesce(g{i}.d, 0) AS d FROM n LEFT JOIN g{i} USING (host))",
        ]
    return f"""WITH {', '.join(ctes)}
SELECT page_id, ruled.host, path, rule, coalesce(rule_verdict, CASE WHEN coalesce(d, 0) > {url_filter.THRESHOLD} * coalesce(t, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN r{rounds} ON ruled.host = r{rounds}.host"""


def line_dedup_sql(source: str = "documents", out: str = "") -> str:
    out = out or "doc_id, n_lines, n_lines - coalesce(n_kept, 0) AS n_dropped, sha256(kept) AS kept_sha256"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, * FROM {source}),
l AS (SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^{BLANK_SET}+|{BLANK_SET}+$', '', 'g'), '{UP}', '{LOW}') AS key FROM l),
c AS (SELECT key, count(DISTINCT rid) AS n, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key),
a AS (SELECT rid, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY pos) AS kept FROM k LEFT JOIN c USING (key) WHERE coalesce(n, 0) < 3 OR doc_id IS NULL OR owner IS NULL OR doc_id = owner GROUP BY rid),
t AS (SELECT rid, count(*) AS n_lines FROM l GROUP BY rid),
r AS (SELECT d.* EXCLUDE (rid), n_lines, n_kept, coalesce(kept, '') AS kept FROM d JOIN t USING (rid) LEFT JOIN a USING (rid))
SELECT {out} FROM r"""


EXACT_DEDUP_SQL = rf"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '{BLANK_SET}+', '', 'g') AS content FROM documents),
g AS (SELECT content, first(doc_id ORDER BY n_chars DESC, doc_id ASC NULLS LAST) AS keep_id, count(*) AS group_size FROM d GROUP BY content)
SELECT d.doc_id, keep_id, group_size, d.doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(content) AS text_sha256 FROM d JOIN g USING (content)"""


def chat_format_sql() -> str:
    def escaped(c: str) -> str:
        out = rf"replace(coalesce({c}, ''), '\', '\\')"
        for mark in chat_format.MARKS:
            out = rf"replace({out}, '{mark}', '{mark[0]}\{mark[1:]}')"
        return out

    frame = len("<s>[INST][/INST]</s>")
    return f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum({frame} + length({escaped('role')}) + length({escaped('text')}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""

#: op13. CRC-32 bit by bit; a run of period q shows as neighbouring pairs (i, i + q) of equal 16-word
#: stretches, since a wanted run has 16 words more than its period.
PERIOD_RUNS_SQL = r"""WITH d0 AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
d1 AS (SELECT rid, doc_id, w, len(w)::BIGINT AS n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(0, 8), lambda z: 0::BIGINT)), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS h FROM d0),
d2 AS (SELECT *, (h // 10) % n AS a, (h // 10) % 8 + 3 AS k FROM d1),
d AS MATERIALIZED (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END + 1]) ELSE w END AS w FROM d2),
t AS MATERIALIZED (SELECT rid, unnest(range(0, n)) AS i, unnest(w) AS word FROM d),
s AS MATERIALIZED (SELECT rid, i, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS stretch FROM t),
e AS (SELECT x.rid, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.rid = y.rid AND x.stretch = y.stretch AND x.i < y.i JOIN d ON d.rid = x.rid AND y.i + 16 <= d.n),
g AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM e),
r0 AS (SELECT rid, min(i) AS start, max(i) - min(i) + 16 + q AS length, q FROM g GROUP BY rid, q, island),
r AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM r0 GROUP BY rid, start, length HAVING length >= 24 AND length >= 3 * min(q)),
b AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM r),
o AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM r GROUP BY rid),
kept AS (SELECT t.rid, string_agg(word, ' ' ORDER BY t.i) AS said FROM t LEFT JOIN (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r) x ON x.rid = t.rid AND x.i = t.i WHERE x.i IS NULL GROUP BY t.rid)
SELECT d.doc_id, coalesce(o.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
  sha256(coalesce(o.said, '')) AS runs_sha256, sha256(coalesce(kept.said, '')) AS collapsed_sha256
FROM d LEFT JOIN o ON o.rid = d.rid LEFT JOIN b ON b.rid = d.rid AND b.k = 1 LEFT JOIN kept ON kept.rid = d.rid"""

#: op11. Every group against every other over every kept term, in numbers of 128 bits.
SOURCE_DIVERGENCE_SQL = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{UP}', '{LOW}') AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p,
  1 + 1000000000::HUGEINT * (all_n + 1) // (sum(all_n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS q FROM grid),
priced AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT x.lang, x.source, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN priced z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200"""

#: op12. All pairs of a label; components by following links.
EMBEDDING_DEDUP_SQL = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
ok AS MATERIALIZED (SELECT rid, vec_id, label, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND len(vec) > 0 AND len(list_filter(vec, lambda x: x IS NOT NULL AND isfinite(x))) = len(vec) AND len(list_filter(vec, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.label = b.label AND a.rid <> b.rid AND len(a.vec) = len(b.vec) WHERE list_dot_product(a.vec, b.vec) / (a.norm * b.norm) >= 0.98),
reach(rid, other) AS (SELECT rid, rid FROM v UNION SELECT reach.rid, link.b FROM reach JOIN link ON link.a = reach.other),
least AS (SELECT reach.rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.other GROUP BY reach.rid),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least ON least.rid = v.rid LEFT JOIN degree ON degree.a = v.rid"""
