"""Signed propagation over a graph: effects on a panel, blocked nodes, combinations and partners.

edges: (s, t, w), w being the edge's sign over the number of edges that leave s. An effect runs along
the edges, its steps weaker by ``decay`` each, and is read at a panel (node, weight).

Effects on a panel are spread backwards from it, so that rows are panel nodes times nodes, however
many sources are asked. Every step is summed and kept before the next.

What a source loses when a node is blocked is summed over the walks that come to that node: the walks
that come to it first after j steps, times what it passes on in the steps that are left. First
arrivals are all arrivals without the later ones, which are earlier first arrivals times walks from
the node back to itself. So all (source, blocked node) pairs come from one propagation from the
sources, not from one for each pair; ``onward`` with blocked nodes is the plain way, for any steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphev.functions.shared import saved

STEPS, DECAY = 4, 0.5
#: Effects under these are no effects: of one perturbation, and of a source on a node it touches.
EFFECT_FLOOR, TOUCH_FLOOR = 5e-4, 1e-4
#: A change of a source's effect by this share of it is more than independence.
CLASS_SHARE = 0.25


def signed_edges(view: DataFrame, signed: bool = True) -> DataFrame:
    """view (source_name, target_name, name) -> (s, t, w). Edges without a direction of effect
    (modulates) carry none; unsigned: every sign is +1."""
    rows = view.filter("name <> 'modulates'").select(F.col("source_name").alias("s"), F.col("target_name").alias("t"), F.when((F.col("name") == "inhibits") & F.lit(signed), -1.0).otherwise(1.0).alias("sign"))
    return rows.join(rows.groupBy("s").agg(F.count("*").alias("n")), "s").groupBy("s", "t").agg((F.sum("sign") / F.first("n")).alias("w"))


def _total(steps: list[DataFrame], key: list[str], decay: float) -> DataFrame:
    each = [step.select(*key, (decay**k * F.col("x")).alias("x")) for k, step in enumerate(steps, 1)]
    return reduce(DataFrame.unionByName, each).groupBy(*key).agg(F.sum("x").alias("total"))


def forward_steps(edges: DataFrame, starts: DataFrame, steps: int = STEPS, blocked: DataFrame | None = None) -> list[DataFrame]:
    """starts (config, node, x), blocked (config, node) -> for every step the table (config, node, x)."""
    out, now = [], starts.select("config", "node", "x")
    for _ in range(steps):
        moved = now.join(edges, F.col("node") == F.col("s")).select("config", F.col("t").alias("node"), (F.col("x") * F.col("w")).alias("x"))
        if blocked is not None:
            moved = moved.join(blocked, ["config", "node"], "left_anti")
        now = saved(moved.groupBy("config", "node").agg(F.sum("x").alias("x")))
        out.append(now)
    return out


def onward(edges: DataFrame, starts: DataFrame, steps: int = STEPS, decay: float = DECAY, blocked: DataFrame | None = None) -> DataFrame:
    """(config, node, total): each configuration's effect on every node it reaches. A configuration
    is one or more perturbed nodes, and the nodes that its walks must not enter."""
    return _total(forward_steps(edges, starts, steps, blocked), ["config", "node"], decay)


def backward_steps(edges: DataFrame, panel: DataFrame, steps: int = STEPS) -> list[DataFrame]:
    """panel (part, node, x) -> for every step the table (part, node, x): what node passes on to part."""
    out, now = [], panel.select("part", "node", "x")
    for _ in range(steps):
        moved = now.withColumnRenamed("node", "t").join(edges, "t").select("part", F.col("s").alias("node"), (F.col("x") * F.col("w")).alias("x"))
        now = saved(moved.groupBy("part", "node").agg(F.sum("x").alias("x")))
        out.append(now)
    return out


def effects(edges: DataFrame, panel: DataFrame, steps: int = STEPS, decay: float = DECAY) -> DataFrame:
    """(part, node, total): every node's effect on each part of the panel."""
    return _total(backward_steps(edges, panel, steps), ["part", "node"], decay)


def reverse_reach(edges: DataFrame, ends: DataFrame, steps: int = STEPS) -> DataFrame:
    """Edges (s, t), ends (node) -> (node, steps): what reaches an end within the steps, the fewest.
    Ends themselves count when a walk from them comes to an end. Each step asks only for what is new."""
    found, now = None, ends.select("node").distinct()
    for k in range(1, steps + 1):
        new = now.withColumnRenamed("node", "t").join(edges.select("s", "t").distinct(), "t").select(F.col("s").alias("node")).distinct()
        if found is not None:
            new = new.join(found, "node", "left_anti")
        now = saved(new.select("node", F.lit(k).alias("steps")))
        found = now if found is None else found.unionByName(now)
    return found


def interactions(edges: DataFrame, sources: DataFrame, panel: DataFrame, pairs: DataFrame | None = None, steps: int = STEPS, decay: float = DECAY) -> tuple[DataFrame, DataFrame]:
    """sources (a), panel (node, weight), pairs (a, b) or None for all that are touched -> (a, b, lost,
    touch): the part of a's effect that comes through b, and a's effect on b; and (node, effect) of all
    nodes on the panel. Without b the effect of a is its effect minus lost. Up to four steps."""
    if steps > 4:
        raise ValueError("walks of more than four steps are for onward() with blocked nodes")
    whole = panel.groupBy(F.lit("panel").alias("part"), "node").agg(F.sum("weight").alias("x"))
    back = backward_steps(edges, whole, steps)
    passed = [whole.select("node", F.lit(0).alias("m"), "x"), *[b.select("node", F.lit(m).alias("m"), "x") for m, b in enumerate(back, 1)]]
    passed = reduce(DataFrame.unionByName, passed)
    # y0..yn: what a node passes on in at most so many steps
    left = saved(passed.groupBy(F.col("node").alias("b")).agg(*[F.coalesce(F.sum(F.when(F.col("m") <= q, F.pow(F.lit(decay), "m") * F.col("x"))), F.lit(0.0)).alias(f"y{q}") for q in range(steps)]))

    # walks from a node back to itself: of one and two steps for all, of three for the panel, as only
    # they are read after a fourth step
    loops1 = edges.filter("s = t").select(F.col("s").alias("b"), F.col("w").alias("r1"))
    turn = edges.select(F.col("t").alias("s"), F.col("s").alias("t"), F.col("w").alias("v"))
    loops2 = edges.join(turn, ["s", "t"]).groupBy(F.col("s").alias("b")).agg(F.sum(F.col("w") * F.col("v")).alias("r2"))
    ends = whole.select(F.col("node").alias("config"), "node", F.lit(1.0).alias("x"))
    loops3 = forward_steps(edges, ends, 3)[-1].filter("config = node").select(F.col("node").alias("b"), F.col("x").alias("r3"))
    facts = saved(left.join(loops1, "b", "left").join(loops2, "b", "left").join(loops3, "b", "left").fillna(0.0))

    starts = sources.select(F.col("a").alias("config"), F.col("a").alias("node"), F.lit(1.0).alias("x"))
    arrivals = [x.select(F.col("config").alias("a"), F.col("node").alias("b"), F.lit(j).alias("j"), "x") for j, x in enumerate(forward_steps(edges, starts, steps), 1)]
    wide = reduce(DataFrame.unionByName, arrivals)
    if pairs is not None:
        wide = wide.join(pairs.select("a", "b").distinct(), ["a", "b"], "left_semi")
    wide = wide.groupBy("a", "b").agg(*[F.coalesce(F.sum(F.when(F.col("j") == j, F.col("x"))), F.lit(0.0)).alias(f"x{j}") for j in range(1, steps + 1)])
    wide = wide.filter("a <> b").join(facts, "b", "left").fillna(0.0)
    first: list = []
    for j in range(1, steps + 1):
        f = F.col(f"x{j}")
        for i, g in enumerate(first, 1):
            f = f - g * F.col(f"r{j - i}")
        wide = wide.withColumn(f"f{j}", f)
        first.append(F.col(f"f{j}"))
    lost = sum((decay**j * F.col(f"f{j}") * F.col(f"y{steps - j}") for j in range(2, steps + 1)), decay * F.col("f1") * F.col(f"y{steps - 1}"))
    touch = sum((decay**j * F.col(f"x{j}") for j in range(2, steps + 1)), decay * F.col("x1"))
    return wide.select("a", "b", lost.alias("lost"), touch.alias("touch")), _total([b.select("node", "x") for b in back], ["node"], decay).withColumnRenamed("total", "effect")


def partners(edges: DataFrame, sources: DataFrame, panel: DataFrame, k: int = 6, sign: int = 1) -> DataFrame:
    """partners_and_effects without what is lost, and without the effects."""
    return partners_and_effects(edges, sources, panel, k, sign)[0].drop("lost")


def partners_and_effects(edges: DataFrame, sources: DataFrame, panel: DataFrame, k: int = 6, sign: int = 1) -> tuple[DataFrame, DataFrame]:
    """I16: (a, b, gain, lost, k), and (node, effect) of all nodes: the k nodes whose removal raises a's effect on the panel most, ties by
    name; asked are the nodes that a touches and the negative part of the panel. What no walk of a
    comes to changes nothing and is not listed."""
    pairs, effect = interactions(edges, sources, panel)
    survival = panel.filter("weight < 0").select(F.col("node").alias("b"), F.lit(1).alias("_s")).distinct()
    gains = pairs.join(survival, "b", "left").filter(f"abs(touch) > {TOUCH_FLOOR!r} or _s = 1")
    gains = gains.select("a", "b", F.round(0.0 - sign * F.col("lost"), 10).alias("gain"), "lost")
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("gain"), "b"))
    return gains.withColumn("k", rank).filter(F.col("k") <= k), effect


def combinations(edges: DataFrame, pairs: DataFrame, panel: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """I16: pairs (a, sa, b, sb), signs of the two perturbations -> what the sum of both does, and what
    b's removal does to a, where b is inhibited. verdict ABSTAIN: a node that has no edge, or a = b. found: (a, b, lost)
    of the pairs and (node, effect), where interactions() has given them before."""
    known = edges.select(F.col("s").alias("n")).unionByName(edges.select("t").withColumnRenamed("t", "n")).distinct()
    rows = pairs.select("a", "sa", "b", "sb").distinct()
    lost, effect = interactions(edges, rows.select("a").distinct(), panel, rows) if found is None else found
    lost = lost.select("a", "b", "lost")
    at = lambda to: effect.select(F.col("node").alias(to), F.col("effect").alias(f"e{to}"))
    is_known = lambda to: known.select(F.col("n").alias(to), F.lit(True).alias(f"k{to}"))
    rows = rows.join(is_known("a"), "a", "left").join(is_known("b"), "b", "left").join(at("a"), "a", "left").join(at("b"), "b", "left").join(lost, ["a", "b"], "left")
    rows = rows.fillna(0.0, ["ea", "eb", "lost"]).withColumn("ok", F.coalesce(F.col("ka") & F.col("kb") & (F.col("a") != F.col("b")), F.lit(False)))
    rows = rows.withColumns({"da": F.col("sa") * F.col("ea") + 0.0, "db": F.col("sb") * F.col("eb") + 0.0}).withColumn("both", F.col("da") + F.col("db"))
    gain = F.when(F.col("sb") < 0, 0.0 - F.col("sa") * F.col("lost"))
    share = F.when(F.abs("da") > 1e-12, gain / F.abs("da")).otherwise(0.0)
    kind = F.when(gain.isNull(), "n/a").when(share > CLASS_SHARE, "SYNERGY").when(share < -CLASS_SHARE, "ANTAGONISM").otherwise("independent")
    weak = (F.abs("da") < EFFECT_FLOOR) | (F.abs("db") < EFFECT_FLOOR)
    said = {
        "effect_a": F.round("da", 5), "effect_b": F.round("db", 5), "additive": F.round("both", 5), "direction": F.when(F.col("both") > 0, "death").otherwise("survival"),
        "emergent": weak & (F.abs("both") >= EFFECT_FLOOR), "a_without_b": F.round(F.col("da") + gain, 5), "interaction": F.round(gain, 5), "structure": kind,
    }
    return rows.select("a", "sa", "b", "sb", F.when(F.col("ok"), "EXPLAINED").otherwise("ABSTAIN").alias("verdict"), *[F.when(F.col("ok"), c).alias(n) for n, c in said.items()])


def threshold_pairs(effects_: DataFrame, threshold: float, floor: float = 1e-4, grid: tuple[float, ...] = (), buckets: int = 64) -> DataFrame:
    """effects_ (node, signal, buffer) -> pairs a < b of nodes that each stay under the threshold
    alone and pass it together, best first to be ordered by committed: (a, b, committed, role_a, role_b,
    holds: at how many thresholds of the grid the same is true).

    A pair can only pass if its two numbers signal - buffer have a sum over threshold + floor. Nodes are
    dealt to buckets of that number, and a bucket is joined with those that it can pass with."""
    commit = lambda s, b, at: F.greatest(F.lit(0.0), s - F.greatest(F.lit(0.0), F.lit(at) + b))
    s, b = F.col("signal"), F.col("buffer")
    fit = effects_.filter((commit(s, b, threshold) <= 1e-9) & ((F.abs(s) > floor) | (F.abs(b) > floor))).select("node", "signal", "buffer", (s - b).alias("u"))
    fit = saved(fit)
    low, high = fit.agg(F.coalesce(F.min("u"), F.lit(0.0)), F.coalesce(F.max("u"), F.lit(0.0))).first()
    width = max((high - low) / buckets, 1e-12)
    at = F.least(F.lit(buckets - 1), F.floor((F.col("u") - low) / width)).cast("int")
    fit = fit.withColumn("bucket", at)
    # the largest u of bucket i is low + (i + 1) * width; what it needs of the other is the rest
    least = F.greatest(F.lit(0), F.floor((threshold + floor - (low + (F.col("bucket") + 1) * width) - low) / width).cast("int") - 1)
    one = fit.filter(least < buckets).select(F.col("node").alias("a"), F.col("signal").alias("sa"), F.col("buffer").alias("ba"), F.explode(F.sequence(least, F.lit(buckets - 1))).alias("bucket"))
    two = fit.select(F.col("node").alias("b"), F.col("signal").alias("sb"), F.col("buffer").alias("bb"), "bucket")
    both = one.join(two, "bucket").filter("a < b").withColumn("committed", commit(F.col("sa") + F.col("sb"), F.col("ba") + F.col("bb"), threshold)).filter(F.col("committed") > floor)
    alone = lambda x, at: commit(F.col(f"s{x}"), F.col(f"b{x}"), at) <= 1e-9
    holds = [(alone("a", g) & alone("b", g) & (commit(F.col("sa") + F.col("sb"), F.col("ba") + F.col("bb"), g) > 1e-9)).cast("int") for g in grid]
    role = F.when(F.col("sa") >= F.col("sb"), "driver").otherwise("sensitizer")
    other = F.when(F.col("sa") >= F.col("sb"), "sensitizer").otherwise("driver")
    return both.select("a", "b", "committed", role.alias("role_a"), other.alias("role_b"), reduce(lambda x, y: x + y, holds, F.lit(0)).alias("holds"))
