"""Chat formatting of reply trees with DataFrame operations only.

A reply table has one row per message: tree, node, parent (null at a root), role, text, score.
Iterative self-joins double the known ancestor distance of every node, then walk the distances
from the largest power of two to the smallest, so every root-to-leaf path is enumerated in a
number of rounds that is logarithmic in the longest path. Branches are ranked by the summed score
of their messages, and each chosen path becomes one conversation.

The template writes ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` for each message. Inside roles and texts
``%``, ``<`` and ``[`` are written ``%p``, ``%l`` and ``%b``, so no control string of this or a similar template
survives there, and reading back undoes it exactly. The loss mask lists, in order, where the
assistant's texts stand in the formatted string (start from 0, length, in code points).

Null texts and roles count as empty, null scores as 0. Rows with a null tree are one tree of their
own. A node named twice in a tree keeps the row with the smallest (role, text); a parent that does
not exist makes its child a root. Cycles, and replies below them, have no root and yield no path; other
paths of the table are not touched. An empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfabric.scratch import materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    """Write control characters of the template so that none is left."""
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%p")), F.lit("<"), F.lit("%l")), F.lit("["), F.lit("%b"))


def unescape(c: Column) -> Column:
    """Undo ``escape``; every remaining % starts a two-character code, so the order is free of overlaps."""
    return F.replace(F.replace(F.replace(c, F.lit("%b"), F.lit("[")), F.lit("%l"), F.lit("<")), F.lit("%p"), F.lit("%"))


def paths(replies: DataFrame) -> DataFrame:
    """Rows (tree, leaf, node, depth from the leaf) for every node on every root-to-leaf path.

    ``replies`` has (tree, node, parent); (tree, node) is unique.
    """
    spark = replies.sparkSession
    base = replies.select("tree", "node", "parent")
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known")).dropDuplicates(["tree", "parent"])
    links = base.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"))
    # hops[k]: (tree, node, the ancestor 2^k steps up), only where there is one
    hops = [materialize(links.where("up is not null"), "hop")]
    count = hops[0].count()
    while count:
        last, before = hops[-1], count
        far = last.select("tree", F.col("node").alias("up"), F.col("up").alias("far"))
        hops.append(materialize(last.join(far, ["tree", "up"]).select("tree", "node", F.col("far").alias("up")), "hop"))
        count = hops[-1].count()
        if count == before:  # a path has nodes at every distance from its root, so all that is left goes round
            endless = hops[-1].select("tree", "node")
            hops = [h.join(endless, ["tree", "node"], "left_anti") for h in hops[:-1]]
            links = links.join(endless, ["tree", "node"], "left_anti")
            base = base.join(endless, ["tree", "node"], "left_anti")
            break
    inner = links.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = base.select("tree", "node").join(inner, ["tree", "node"], "left_anti")
    walk = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth"))
    for k in range(len(hops) - 1, -1, -1):
        jumped = walk.join(hops[k], ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") + (1 << k)).alias("depth"))
        walk = materialize(walk.unionByName(jumped), "walk")
    return walk


def format_trees(replies: DataFrame, best: int | None = None) -> DataFrame:
    """Rows (tree, leaf, rank, score, n_turns, formatted, mask): one conversation per root-to-leaf path.

    ``best`` keeps that many paths of each tree, those of the highest summed score, then the smallest leaf.
    """
    kind = replies.schema["tree"].dataType
    tagged = replies.select(
        F.to_json(F.struct(F.col("tree").alias("t"))).alias("tree"),
        F.col("node").cast("long").alias("node"),
        F.col("parent").cast("long").alias("parent"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        (F.coalesce(F.col("score"), F.lit(0.0)) if "score" in replies.columns else F.lit(0.0)).cast("double").alias("score"),
    ).where("node is not null")
    said = tagged.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m"))
    said = materialize(said.select("tree", "node", "m.role", "m.text", "m.parent", "m.score"), "replies")
    turn = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")), F.lit(END))
    turns = paths(said).join(said.drop("parent"), ["tree", "node"])
    role_size, text_size = F.length(escape(F.col("role"))).cast("long"), F.length(escape(F.col("text"))).cast("long")
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a text ends where its turn does, less the closing mark
    stop = F.sum(role_size + text_size + len(TURN) + len(TEXT) + len(END)).over(order) - len(END)
    placed = turns.withColumn("stop", stop).withColumn("size", text_size)
    piece = F.struct(
        (-F.col("depth")).alias("at"),
        turn.alias("body"),
        (F.col("stop") - F.col("size")).alias("start"),
        F.col("size").alias("length"),
        (F.col("role") == ASSISTANT).alias("learn"),
    )
    joined = placed.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.sort_array(F.collect_list(piece)).alias("turns"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    ranked = joined.withColumn("rank", rank)
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    learned = F.filter("turns", lambda x: x["learn"])
    mask = F.transform(learned, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    tree = F.from_json("tree", f"t {kind.simpleString()}")["t"]
    return ranked.select(
        tree.alias("tree"),
        "leaf",
        "rank",
        "score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: x["body"]), "").alias("formatted"),
        mask.alias("mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    parts = F.slice(F.split(formatted, r"<\|end\|>", -1), 1, F.size(F.split(formatted, r"<\|end\|>", -1)) - 1)
    halves = F.transform(parts, lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), r"<\|text\|>", -1))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, joined without separators."""
    cut = F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return F.array_join(cut, "")


def chain_replies(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as reply trees in which each row answers the one before it.

    Rows of a conversation are numbered by (turn, role, text), so that equal and null turns have a
    defined order (nulls first).
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
