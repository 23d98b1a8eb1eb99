"""Embedding near-dedup: all pairs of vectors of a label at a cosine of ``bar`` or more, by dual
traversal of cover trees.

Vectors are compared as points of the unit sphere, where a cosine of c is a distance of
sqrt(2 - 2c). Vectors of one label with the same components are one class, compared once and counted
with its size. A cover tree has a node for each ball: its centre is a point, its children's centres
lie more than half its scale apart (the first is its own centre again), and its points are dealt to
the nearest of them; scales halve from level to level. What decides is each node's covering radius,
the exact largest distance of its points from its centre: two nodes whose centres are further apart
than their radii and the wanted distance hold no pair, and neither do their children.

The tree's upper levels are fitted on a bounded sample: one class in ``BLOCK``, at most
``SAMPLE_ROWS`` and ``SAMPLE_BYTES``. Every class is then dealt down that tree by Spark tasks, and
radii are taken over all classes. A leaf with more than BLOCK classes is cut into blocks, which are
its children, so no task holds more than two blocks. The dual traversal goes down level by level
as joins of node pairs with their children, bounds deciding in the join; pairs of blocks that
remain are one task's work each, where both blocks grow their own lower levels and are walked in the
same way down to matrix products. A label that the sample misses has one leaf around the origin.

A task hands on no pairs but what they add up to: each class's number of links, and a spanning forest
of the links between the two blocks, so that a dense group of m classes costs m rows and not m^2;
components of the forests are components of the links. ``near_pairs`` gives the pairs themselves.

Bounds prune what is clustered. Vectors without any structure, all about as far from each other, are
further apart than no bound tells before they are leaves of their own: then every pair of blocks of
a label is compared, by matrix products.

Null labels, null and empty vectors, zero vectors and vectors with a null or non-finite component
link with nothing, and vectors of different lengths do not link. Rows with equal vectors link with each
other, also where they share a vec_id. Null vec_ids take part; a component's id is its smallest
vec_id, null only if it has none. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphev.llm.common import hash128, saved, table
from graphev.operators.components import components

BAR = 0.98
BLOCK, SAMPLE_ROWS, SAMPLE_BYTES = 4096, 8192, 8 << 20
#: Scale of the first net under a root, and the scale under which nodes are not split.
FIRST_SCALE, LAST_SCALE = 2.0, 0.05
#: In a task: points of a leaf, and children of a node. Points that need more are a leaf.
LEAF, FAN = 256, 48
#: Distances from cosines in double precision are off by less.
SLACK = 1e-6
TILE = 1024
PAIR = "a long, b long, n long, cosine double"


@dataclass
class Node:
    centre: np.ndarray
    points: np.ndarray
    radius: float
    kids: list[Node] = field(default_factory=list)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distance(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Of unit vectors from a centre, which is one too or the origin."""
    return np.sqrt(np.maximum(0.0, 1.0 + float(centre @ centre) - 2.0 * (x @ centre)))


def grow(x: np.ndarray, points: np.ndarray, centre: np.ndarray, scale: float, leaf: int, fan: int) -> Node:
    """The node of some rows of x. Its net is taken farthest point first, until all are within half the
    scale of a centre; a net of one is left out and its half is tried. More than ``fan`` centres: a leaf."""
    near = distance(x[points], centre)
    node = Node(centre, points, float(near.max(initial=0.0)))
    while len(points) > leaf and scale / 2 >= LAST_SCALE:
        scale /= 2
        if node.radius <= scale:
            continue
        # the origin is not a point: its net starts with the point that is farthest from it
        centres = [centre] if centre.any() else [x[points[int(near.argmax())]]]
        gap, home = distance(x[points], centres[0]), np.zeros(len(points), int)
        while gap.max() > scale and len(centres) <= fan:
            centres.append(x[points[int(gap.argmax())]])
            new = distance(x[points], centres[-1])
            closer = new < gap
            gap[closer], home[closer] = new[closer], len(centres) - 1
        if len(centres) > fan:
            break
        if len(centres) > 1:
            node.kids = [grow(x, points[home == k], c, scale, leaf, fan) for k, c in enumerate(centres)]
            break
    return node


def leaf_pairs(a: Node, b: Node, reach: float):
    """Pairs of leaves that may hold points within reach; a is b: each pair of its leaves once."""
    stack = [(a, b)]
    while stack:
        one, two = stack.pop()
        if one is not two and float(distance(one.centre[None], two.centre)[0]) > one.radius + two.radius + reach + SLACK:
            continue
        if not one.kids and not two.kids:
            yield one, two
        elif one is two:
            stack += [(k, m) for i, k in enumerate(one.kids) for m in one.kids[i:]]
        elif not two.kids or (one.kids and one.radius >= two.radius):
            stack += [(k, two) for k in one.kids]
        else:
            stack += [(one, k) for k in two.kids]


def links(xa: np.ndarray, xb: np.ndarray | None, bar: float):
    """(i, j, cosine) arrays of the pairs at bar or more: between rows of xa and xb, or in xa."""
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * bar))
    origin = np.zeros(xa.shape[1])
    a = grow(xa, np.arange(len(xa)), origin, FIRST_SCALE, LEAF, FAN)
    b = a if xb is None else grow(xb, np.arange(len(xb)), origin, FIRST_SCALE, LEAF, FAN)
    y = xa if xb is None else xb
    for one, two in leaf_pairs(a, b, reach):
        for k in range(0, len(one.points), TILE):
            rows = one.points[k : k + TILE]
            cosine = xa[rows] @ y[two.points].T
            i, j = np.nonzero(cosine >= bar)
            value, i, j = cosine[i, j], rows[i], two.points[j]
            once = slice(None) if one is not two else i < j
            yield i[once], j[once], value[once]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the edges (i, j) join it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def vectors_of(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return units(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def compare(part: pa.Table, bar: float, every: bool) -> pa.Table:
    """One pair of blocks: rows (side, cid, w, vec). ``every``: all pairs; else each class's number of
    links (a, n) and edges (a, b) of a spanning forest."""
    part = part.sort_by([("side", "ascending"), ("cid", "ascending")])
    cid, w = part["cid"].to_numpy(), part["w"].to_numpy()
    x, m = vectors_of(part["vec"]), int((part["side"].to_numpy() == 0).sum())
    two_sided = m < len(x)
    found = list(links(x[:m], x[m:] if two_sided else None, bar))
    i, j, cosine = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in range(3))
    j = j + m if two_sided else j
    if every:
        return pa.table({"a": cid[i], "b": cid[j], "n": np.zeros(len(i), np.int64), "cosine": cosine.astype(float)})
    n = np.zeros(len(x), np.int64)
    np.add.at(n, i, w[j])
    np.add.at(n, j, w[i])
    root = forest(len(x), i, j)
    some, below = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(x)))
    a, b = np.concatenate((cid[some], cid[below])), pa.array(np.concatenate((cid[some], cid[root[below]])), mask=np.arange(len(some) + len(below)) < len(some))
    return pa.table({"a": a, "b": b, "n": np.concatenate((n[some], np.zeros(len(below), np.int64))), "cosine": pa.nulls(len(a), pa.float64())})


@dataclass
class Router:
    """The sampled upper levels of one label's tree: a node's centre, and its children's numbers."""

    centres: list[np.ndarray]
    kids: list[list[int]]

    @staticmethod
    def fitted(x: np.ndarray) -> Router:
        out, todo = Router([], []), [grow(x, np.arange(len(x)), np.zeros(x.shape[1]), FIRST_SCALE, 1, len(x))]
        for node in todo:  # breadth first: a node's number is its place in the list
            out.centres.append(node.centre)
            out.kids.append([len(todo) + k for k in range(len(node.kids))])
            todo += node.kids
        return out

    def paths(self, x: np.ndarray) -> list[list[tuple[int, float]]]:
        """Each row's nodes from the root to a leaf, with its distances from their centres."""
        out = [[(0, 1.0)] for _ in x]
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not self.kids[at] or not len(rows):
                continue
            gaps = np.stack([distance(x[rows], self.centres[k]) for k in self.kids[at]])
            home = gaps.argmin(axis=0)
            for r, k, gap in zip(rows.tolist(), home.tolist(), gaps[home, np.arange(len(rows))].tolist()):
                out[r].append((self.kids[at][k], gap))
            todo += [(kid, rows[home == k]) for k, kid in enumerate(self.kids[at])]
        return out

    def depth(self) -> int:
        deep = [0] * len(self.kids)
        for node, kids in enumerate(self.kids):
            for k in kids:
                deep[k] = deep[node] + 1
        return max(deep)


def comparable(vec: Column, label: Column) -> Column:
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & good, F.lit(False))


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, grp, vec, ok, h1, h2; grp: a label and a length, within which vectors are compared."""
    rows = vectors.select("vec_id", F.col("label").alias("grp"), F.col("embedding").alias("vec"))
    h1, h2 = hash128("grp", "vec")
    grp = F.concat_ws(":", F.size("vec"), F.col("grp").cast("string"))
    return rows.select("vec_id", grp.alias("grp"), "vec", comparable(F.col("vec").cast("array<double>"), F.col("grp")).alias("ok"), h1.alias("h1"), h2.alias("h2"))


def classes_of(rows: DataFrame) -> DataFrame:
    """Distinct vectors of a label: cid, grp, vec, least (vec_id), w (rows), h1, h2. Should one hash pair
    ever belong to two vectors, the job stops."""
    found = rows.filter("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"), F.min(F.struct("grp", "vec")).alias("lo"), F.max(F.struct("grp", "vec")).alias("hi"))
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.lit("two vectors have one hash")).cast(dict(found.dtypes)["lo"]))
    found = found.withColumn("lo", one)
    return saved(found.select(F.monotonically_increasing_id().alias("cid"), "lo.grp", "lo.vec", "least", "w", "h1", "h2"))


def fitted_routers(classes: DataFrame, block: int) -> dict[str, Router]:
    n, size = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    rows = min(-(-n // block), SAMPLE_ROWS, SAMPLE_BYTES // (8 * size))
    sample = classes.orderBy("h1", "h2").limit(rows).select("grp", "vec").collect()
    by: dict[str, list] = {}
    for grp, vec in sample:
        by.setdefault(grp, []).append(vec)
    return {grp: Router.fitted(units(np.array(vecs, float))) for grp, vecs in by.items()}


def compared(classes: DataFrame, bar: float, block: int, every: bool) -> DataFrame:
    """The tasks' rows (PAIR) over all pairs of blocks that the traversal leaves."""
    spark, routers, reach = classes.sparkSession, fitted_routers(classes, block), math.sqrt(max(0.0, 2.0 - 2.0 * bar))

    def route(batches):
        for batch in batches:
            grps, vecs = np.array(batch.column(1).to_pylist(), object), batch.column(3)
            paths = [[(0, 1.0)]] * len(grps)
            for grp in set(grps.tolist()) & set(routers):
                at = np.flatnonzero(grps == grp)
                for k, path in zip(at.tolist(), routers[grp].paths(vectors_of(vecs.take(pa.array(at))))):
                    paths[k] = path
            nodes, gaps = (pa.array([[p[k] for p in path] for path in paths], pa.list_(kind)) for k, kind in ((0, pa.int64()), (1, pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes, gaps], names=["cid", "grp", "w", "vec", "nodes", "gaps"])

    kind = dict(classes.dtypes)["vec"]
    routed = saved(classes.select("cid", "grp", "w", "vec").mapInArrow(route, f"cid long, grp string, w long, vec {kind}, nodes array<long>, gaps array<double>"))
    leaf = F.element_at("nodes", -1)
    sizes = routed.groupBy("grp", leaf.alias("leaf")).agg(F.count("*").alias("n"))
    cut = F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / block))
    points = saved(routed.withColumn("leaf", leaf).join(sizes, ["grp", "leaf"]).withColumn("block", F.shiftleft(cut + 1, 32) + F.col("leaf")).select("cid", "grp", "w", "vec", "nodes", "gaps", "leaf", "block"))

    radii = points.select("grp", F.explode(F.arrays_zip("nodes", "gaps")).alias("at")).groupBy("grp", F.col("at.nodes").alias("node")).agg(F.max("at.gaps").alias("radius"))
    blocks = points.groupBy("grp", "leaf", "block").agg(F.max(F.element_at("gaps", -1)).alias("radius"))
    fitted = [(grp, k, centre.tolist()) for grp, r in routers.items() for k, centre in enumerate(r.centres)]
    centres = spark.createDataFrame(fitted, "grp string, node long, centre array<double>")
    below = spark.createDataFrame([(grp, k, kid) for grp, r in routers.items() for k, kids in enumerate(r.kids) for kid in kids], "grp string, node long, kid long")
    # the children of each node: the router's, a leaf's blocks, and each block itself
    inner = below.join(radii.withColumnRenamed("node", "kid"), ["grp", "kid"]).join(centres.withColumnRenamed("node", "kid"), ["grp", "kid"]).select("grp", "node", "kid", "centre", "radius")
    outer = blocks.join(centres.withColumnRenamed("node", "leaf"), ["grp", "leaf"], "left").select("grp", "leaf", "block", F.coalesce("centre", F.array().cast("array<double>")).alias("centre"), "radius")
    kids = saved(inner.unionByName(outer.select("grp", F.col("leaf").alias("node"), F.col("block").alias("kid"), "centre", "radius")).unionByName(outer.select("grp", F.col("block").alias("node"), F.col("block").alias("kid"), "centre", "radius")))

    # an unsampled label's centre is the origin, written as no components
    gap = "sqrt(aggregate(zip_with(x.centre, y.centre, (p, q) -> (coalesce(p, 0D) - coalesce(q, 0D)) * (coalesce(p, 0D) - coalesce(q, 0D))), 0D, (s, z) -> s + z))"
    pairs = points.select("grp", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    for _ in range(1 + max([r.depth() for r in routers.values()], default=0)):
        x = kids.select("grp", F.col("node").alias("a"), F.struct("kid", "centre", "radius").alias("x"))
        y = kids.select("grp", F.col("node").alias("b"), F.struct("kid", "centre", "radius").alias("y"))
        both = pairs.join(x, ["grp", "a"]).join(y, ["grp", "b"]).filter("a <> b or x.kid <= y.kid")
        pairs = both.filter(f"x.kid = y.kid or {gap} <= x.radius + y.radius + {reach + SLACK!r}").select("grp", F.col("x.kid").alias("a"), F.col("y.kid").alias("b"))
    pairs = saved(pairs.select(F.monotonically_increasing_id().alias("pid"), "grp", "a", "b"))
    sides = pairs.select("pid", "grp", F.explode(F.expr("if(a = b, array(named_struct('side', 0, 'block', a)), array(named_struct('side', 0, 'block', a), named_struct('side', 1, 'block', b)))")).alias("s")).select("pid", "grp", "s.side", "s.block")
    work = sides.join(points.select("grp", "block", "cid", "w", "vec"), ["grp", "block"]).select("pid", "side", "cid", "w", "vec")
    return work.groupBy("pid").applyInArrow(lambda part: compare(part, bar, every), PAIR)


def linked_vectors(vectors: DataFrame, bar: float = BAR, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding, label) -> one row per row: vec_id, n_links, component_id, kept."""
    rows = keyed(vectors)
    classes = classes_of(rows)
    found = saved(compared(classes, bar, block, False))
    degrees = found.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    named = saved(classes.select("cid", "least", "w", "h1", "h2").join(degrees, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = named.join(ids, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    linked = rows.filter("ok").select("vec_id", "h1", "h2").join(facts, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_pairs(vectors: DataFrame, bar: float = BAR, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine): the pairs of distinct vectors at bar or more, each by its smallest vec_id."""
    classes = classes_of(keyed(vectors))
    found = compared(classes, bar, block, True)
    name = lambda to: classes.select(F.col("cid").alias(to), F.col("least").alias(f"least_{to}"))
    return found.join(name("a"), "a").join(name("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"), "cosine")


def op12_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    rows = linked_vectors(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("vec_id").cast("long"), "n_links", F.col("component_id").cast("long"), "kept")
