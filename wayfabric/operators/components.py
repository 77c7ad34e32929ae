"""Connected components by alternating large-star and small-star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every round is two
equi-joins against a per-node minimum; the state is one edge table, rewritten in the shared
scratch folder so that lineage stays short and a lost executor costs one round at most. Stars
are the fixpoint, so the number of rounds is logarithmic in the longest chain of edges. Nothing
but a change counter reaches the driver. The per-node minima are written before they are joined:
both join inputs are then plain exchanges, which adaptive execution may split when one node holds
a large share of the edges.

Before the first round every task contracts the edges that it reads to a forest; what is counted
and small then goes through one task instead of rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfabric.scratch import batches, discard, materialize, spark_read, write_scratch

MAX_ROUNDS = 60
#: Edges up to which one task contracts them all; counted before the choice is made. About 100 bytes an edge there.
ONE_TASK = 2_000_000
#: Edges that a task contracts at once before the first round.
CHUNK = 1_000_000


def components_of_edges(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """Rows (node, component) for every node of ``edges``; component is its smallest reachable node.

    Nulls in either end drop the edge, self-loops keep their node, repeated edges count once, an
    empty table gives an empty result. Node columns are any integer type. Rounds begin where the forests of
    the tasks have more than ``one_task`` edges.
    """
    spark = edges.sparkSession
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")
    )
    # state: one row (node, smaller node) per edge, plus (node, node) for self-loops
    with batches(spark):
        state = write_scratch(known.mapInPandas(_forests, "u long, v long"), "edges")
        count = (nodes := spark_read(spark, state)).count()
        while count > one_task > 0:  # forests of some tasks together, as long as that halves them
            again = write_scratch(nodes.coalesce(max(1, nodes.rdd.getNumPartitions() // 8)).mapInPandas(_forests, "u long, v long"), "edges")
            discard(spark, state)
            state, last = again, count
            count = (nodes := spark_read(spark, state)).count()
            if count > last / 2:
                break
        if count <= one_task:
            return materialize(small_components(nodes, "u", "v"), "labels")
    before = None
    for turn in range(MAX_ROUNDS):
        large = _star(spark_read(spark, state), both_ways=True)
        small = _star(spark_read(spark, large), both_ways=False)
        after = _signature(spark_read(spark, small))
        discard(spark, large)
        if turn:
            discard(spark, state)
        state = small
        if before == after:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    roots = spark_read(spark, state)
    touched = nodes.select(F.col("u").alias("node")).union(nodes.select(F.col("v").alias("node"))).distinct()
    joined = touched.join(roots.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "node", "left")
    return joined.select("node", F.coalesce("root", "node").alias("component"))


def _star(state: DataFrame, both_ways: bool) -> str:
    """One star operation; returns the path of the new edge table with u >= v."""
    proper = state.where(F.col("u") != F.col("v"))
    if both_ways:
        near = proper.union(proper.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = proper
    least = write_scratch(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    spark = state.sparkSession
    linked = near.join(spark_read(spark, least), "u")
    if both_ways:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(spark_read(spark, least).select("u", F.col("m").alias("v")))
    path = write_scratch(out.distinct(), "star")
    discard(spark, least)
    return path


def _signature(state: DataFrame) -> tuple:
    """Order-free digest of an edge table: count and two sums of row hashes."""
    proper = state.where(F.col("u") != F.col("v"))
    row = proper.agg(
        F.count(F.lit(1)),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
        F.sum(F.hash("u", "v").cast("long")),
    ).first()
    return tuple(row)


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, smallest node reachable from each) of edges: all roots that have a smaller neighbour are hooked to it at once."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(u):
        u, v = parent[u], parent[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return nodes, nodes[parent]


def _forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (node, its smallest reachable node) of each chunk of a task; nodes that reach only themselves as loops.

    A forest of at most half a chunk goes into the next chunk instead of out.
    """

    def contract() -> pd.DataFrame:
        node, root = labels(*(np.concatenate([f[c].to_numpy(dtype=np.int64) for f in held]) for c in ("u", "v")))
        lone = np.bincount(np.searchsorted(node, root), minlength=len(node)) == 1
        keep = (node != root) | lone
        return pd.DataFrame({"u": node[keep], "v": root[keep]})

    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= CHUNK:
            held = [contract()]
            size = len(held[0])
            if size > CHUNK // 2:
                yield held[0]
                held, size = [], 0
    if size:
        yield contract()


def small_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) of a counted, small edge table, contracted in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(f["a"].to_numpy(dtype=np.int64), f["b"].to_numpy(dtype=np.int64)) for f in frames]
        if held:
            node, component = labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pd.DataFrame({"node": node, "component": component})

    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).coalesce(1).mapInPandas(run, "node long, component long")


def components(nodes: DataFrame, edges: DataFrame, node: str = "node_id", a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """Rows (``node``, component) for all ``nodes``; a node without edges is its own component.

    The edges are contracted in their tasks; forests of at most ``one_task`` rows (counted) then in one task, larger ones by stars.
    """
    found = components_of_edges(edges, a, b, one_task)
    return nodes.select(node).join(found.withColumnRenamed("node", node), node, "left").select(
        node, F.coalesce("component", F.col(node).cast("long")).alias("component")
    )
