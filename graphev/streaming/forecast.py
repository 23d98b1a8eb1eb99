"""Event windows and decayed forecasts: batch relations, and the same sums as a stream.

events: event_id, ts, entity, source (event type), weight, props.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphev.operators.relation import Relation

DECAY = 0.001

transitions = Relation(
    """SELECT source, target, count(*) AS n FROM (SELECT source, lead(source) OVER (PARTITION BY entity ORDER BY ts, event_id) AS target FROM {events}) q
WHERE target IS NOT NULL AND source <> target GROUP BY source, target""",
    ("events",), {}, "the successors of each event type",
)
decayed_scores = Relation(
    """WITH z AS (SELECT max(ts) AS now FROM {events})
SELECT t.target, round(sum(e.weight * exp(-0.001 * (unix_micros(z.now) - unix_micros(e.ts)) / 1000000.0)), 6) AS score, count(DISTINCT e.source) AS contributors,
round(1 - exp(-0.5 * count(DISTINCT e.source)), 6) AS confidence FROM {events} e JOIN {transitions} t ON t.source = e.source, z GROUP BY t.target""",
    ("events", "transitions"), {}, "L1, L2: what is likely next, older events count less",
)
top_forecast = Relation(
    "SELECT target, score, k FROM (SELECT target, score, row_number() OVER (ORDER BY score DESC, target) AS k FROM {scores}) q WHERE k <= :most", ("scores",), {"most": 5}, "L3"
)
recent = Relation(
    """SELECT source, count(*) AS kept FROM {events} e, (SELECT max(ts) AS now FROM {events}) z WHERE unix_micros(z.now) - unix_micros(e.ts) <= :age * 1000000.0 GROUP BY source""", ("events",), {"age": 86400}, "L4: events that are not too old"
)
structural_prior = Relation(
    """SELECT target, round(least(1.0, sum(n / CAST(every AS DOUBLE)) / greatest(1.0, sqrt(count(*)))), 6) AS prior FROM (SELECT *, sum(n) OVER (PARTITION BY source) AS every FROM {transitions}) q GROUP BY target""", ("transitions",), {}, "L6"
)
sliding_windows = Relation(
    """WITH w AS (SELECT source, CAST(floor(unix_micros(ts) / (:slide * 1000000.0)) AS BIGINT) AS slot FROM {events})
SELECT slot * :slide AS window_start, source, count(*) AS n FROM (SELECT source, slot FROM w UNION ALL SELECT source, slot - 1 FROM w) q GROUP BY slot, source""",
    ("events",), {"slide": 1800}, "L7: windows twice as long as their slide, aligned to the epoch",
)
overlap_gaps = Relation(
    """WITH h AS (SELECT window_start, sum(n) AS n FROM {windows} GROUP BY window_start)
SELECT a.window_start, a.n AS n, b.n AS next_n FROM h a JOIN h b ON b.window_start = a.window_start + :slide WHERE abs(a.n - b.n) > :most""",
    ("windows",), {"slide": 1800, "most": 5}, "L8: neighbouring windows that disagree",
)
causality = Relation(
    """SELECT entity, count(*) AS violations FROM (SELECT entity, source, lag(source) OVER (PARTITION BY entity ORDER BY ts, event_id) AS before FROM {events}) q
WHERE (source = 'signup' AND before = 'purchase') OR (source = 'view' AND before = 'click') GROUP BY entity""",
    ("events",), {}, "L9: an event right after one that it must precede",
)
colocation = Relation(
    """SELECT entity, count(*) AS impossible FROM (SELECT entity, props, ts, lag(props) OVER (PARTITION BY entity ORDER BY ts, event_id) AS p, lag(ts) OVER (PARTITION BY entity ORDER BY ts, event_id) AS t FROM {events}) q
WHERE p <> props AND unix_micros(ts) - unix_micros(t) < 3600000000 GROUP BY entity""",
    ("events",), {}, "L10: two places within an hour",
)
multi_window = Relation(
    "SELECT source, count(DISTINCT window_start) AS windows, min(window_start) AS first_at, max(window_start) AS last_at, max(window_start) - min(window_start) AS span FROM {windows} GROUP BY source", ("windows",), {}, "L11"
)
coherence_summary = Relation(
    "SELECT (SELECT count(*) FROM {gaps}) AS gaps, (SELECT coalesce(sum(violations), 0) FROM {causality}) AS causality, (SELECT coalesce(sum(impossible), 0) FROM {colocation}) AS colocation", ("gaps", "causality", "colocation"), {}, "L12"
)


def decayed_stream(events: DataFrame, transitions: DataFrame, watermark: str = "1 hour", bucket: str = "10 minutes", decay: float = DECAY) -> DataFrame:
    """L1 as a stream: per target and time bucket the weights decayed to the bucket's end. Sums
    only add up, so order does not matter and late events within the watermark count as in a
    batch; decayed_total puts the buckets together at any time. transitions is static."""
    hits = events.withWatermark("ts", watermark).join(transitions.select("source", "target"), "source")
    end = F.window("ts", bucket)["end"]
    aged = F.col("weight") * F.exp(-decay * (F.unix_micros(end) - F.unix_micros("ts")) / 1e6)
    hits = hits.withColumn("aged", aged)
    return hits.groupBy(F.window("ts", bucket), "target").agg(F.sum("aged").alias("part"), F.count("*").alias("n"))


def decayed_total(parts: DataFrame, now, decay: float = DECAY) -> DataFrame:
    """The scores at a time from the buckets of decayed_stream: target, score, n."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("window.end")) / 1e6
    return parts.groupBy("target").agg(F.sum(F.col("part") * F.exp(-decay * age)).alias("score"), F.sum("n").alias("n"))


def windowed_stream(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """L7 as a stream."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", size, slide), "source").agg(F.count("*").alias("n"))
