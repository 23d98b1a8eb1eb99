r"""Reply trees to formatted conversations.

A tree's nodes have a parent in the same tree, or none. Self-joins enumerate the paths from each
leaf to its root: in round k every path adds the members 2^k steps further up, through a table of
2^k-step ancestors that is joined with itself, so that the rounds are the logarithm of the depth.
Branches are ranked by the sum of their nodes' scores (null: 0), then by the leaf; the best
``branches`` of a tree are formatted, one conversation each.

Template: a turn is ``<s>[INST]role[/INST]text</s>``. In roles and texts a backslash is doubled
and a backslash is put behind the first character of ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``,
so no text can look like a mark and the original comes back exactly. ``loss`` lists start and
length (code points) of each assistant text.

Null text or role: empty. A parent that is not in the tree: a root. Nodes whose parents form a
ring raise an error. Repeated rows are nodes of their own. The formatted conversation is one
value, so its turns do meet in one row; nothing else about a tree does. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphev.llm.common import saved, table

#: The marks of the template, as they stand in formatted text.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]")


def escaped(c: Column) -> Column:
    out = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in MARKS:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every member of every root-to-leaf path, up steps above the leaf.
    nodes: tree, node, parent, neither tree nor node null."""
    links = nodes.filter("parent is not null").select("tree", "node", F.col("parent").alias("up_node"))
    known = nodes.select("tree", F.col("node").alias("up_node")).distinct()
    jumps = saved(links.join(known, ["tree", "up_node"], "left_semi").select("tree", "node", "up_node"))
    parents = jumps.select("tree", F.col("up_node").alias("node")).distinct()
    paths = saved(nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    step, total = 1, nodes.count()
    while not jumps.isEmpty():
        if step > total:
            raise ValueError("the parents of some nodes form a ring")
        further = paths.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("up_node").alias("node"), (F.col("up") + step).alias("up"))
        paths = saved(paths.unionByName(further))
        upper = jumps.select("tree", F.col("node").alias("up_node"), F.col("up_node").alias("top"))
        jumps = saved(jumps.join(upper, ["tree", "up_node"]).select("tree", "node", F.col("top").alias("up_node")))
        step *= 2
    return paths


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """nodes: tree, node, parent, role, text, score. One row per chosen path: tree, leaf, rank,
    n_turns, formatted, loss."""
    nodes = nodes.select("tree", "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    members = leaf_paths(nodes).join(nodes.drop("parent"), ["tree", "node"])
    best = members.groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).filter(F.col("rank") <= branches)
    head = F.concat(F.lit("<s>[INST]"), escaped(F.col("role")), F.lit("[/INST]"))
    turns = members.drop("score").join(best.select("tree", "leaf", "rank"), ["tree", "leaf"]).withColumns({"head": head, "body": escaped(F.col("text"))})
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit("</s>")))
    before = W.partitionBy("tree", "leaf", "rank").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0))
    turns = turns.withColumn("start", (at + F.char_length("head")).cast("long"))
    span = F.struct((-F.col("up")).alias("o"), F.col("turn"), F.col("start"), F.char_length("body").cast("long").alias("length"), (F.col("role") == "assistant").alias("learn"))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(span)).alias("t"))
    loss = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return whole.select(
        "tree", "leaf", "rank", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), loss.alias("loss")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.filter(F.split(formatted, "</s>", -1), lambda p: p != "")
    shape = r"(?s)^<s>\[INST\](.*?)\[/INST\](.*)$"
    return F.transform(pieces, lambda p: F.struct(unescaped(F.regexp_extract(p, shape, 1)).alias("role"), unescaped(F.regexp_extract(p, shape, 2)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """A conversation as a tree with one branch: each row's parent is the row before it, by turn,
    then role, then text. tree holds the conv_id as text, and 'null' where there is none."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    rows = conversations.select(tree.alias("tree"), "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    out = format_trees(saved(conversation_nodes(rows))).withColumns({"turns": read_turns(F.col("formatted")), "learnt": read_loss(F.col("formatted"), F.col("loss"))})
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.expr("try_cast(tree as long)").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
