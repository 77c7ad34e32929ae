"""Mixing sources to target weights by hierarchical budgets, with DataFrame operations only.

The columns ``levels`` (for example domain, language, source) form a tree. The root's token budget is
divided among siblings in proportion to their weights, but no node gets more than its subtree can
supply in ``max_epochs`` epochs; what a node cannot use goes to its siblings first, and only when
all of them are full to the siblings of its ancestors. With the nodes in the order of supply per
weight the division has a closed form in running sums, so each level is one window, not a loop.

A leaf given as many tokens as it holds k times over, and a rest, contributes k whole epochs and
the rest's prefix of epoch k: the longest prefix, in the order of md5(seed:epoch:id), whose tokens
sum to at most the rest. The order's first hexadecimal digits deal a leaf's rows into 256
buckets, the next the bucket in which the prefix ends into 256 more; whole buckets are decided by
their sums and only the last one is sorted, so a leaf with a large part of all rows is not gathered
in one task.

Null level values are values of their own, null texts hold no tokens, rows with a null id sort by an
empty id, repeated rows count each. Rows without tokens before the prefix's end are kept. An empty
table, a zero budget or zero weights select nothing. Extra columns pass through, whatever their names;
the added columns are ``n_tokens`` and ``epoch``, with a ``_`` where the table has these names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfabric.llm._names import fresh
from wayfabric.scratch import materialize

#: Hexadecimal digits of the order's hash that a round of bucket sums adds to a bucket's name, and rounds.
DIGITS, ROUNDS = 2, 2


def words_between_spaces(text: Column) -> Column:
    """Tokens of a text for budgeting: its spaces and one; none for null and empty texts."""
    n = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(n).cast("long")


def _weight(col: Column, weights: Mapping | None) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    out = F.lit(weights.get(None, 1) if None in weights else 1)
    for value, w in weights.items():
        if value is not None:
            out = F.when(col == F.lit(value), F.lit(int(w))).otherwise(out)
    return out.cast("long")


def allocate(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping], budget: Column, max_epochs: int) -> DataFrame:
    """Adds ``given``, the tokens that each leaf of (levels..., tokens) is to contribute."""
    capped = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = capped.agg(F.least(budget, F.sum("cap")).alias("given"))
    parent, above = total, []
    for depth, level in enumerate(levels):
        keys = list(levels[: depth + 1])
        nodes = capped.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col(level), weights.get(level)))
        nodes = nodes.where("cap > 0 and weight > 0")
        up = parent.select(*[F.col(k).alias(f"_up_{k}") for k in above], F.col("given").alias("_budget"))
        cond = F.lit(True)
        for k in above:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_up_{k}"))
        nodes = nodes.join(up, cond) if above else nodes.join(up)
        nodes = nodes.select(*keys, "cap", "weight", "_budget")
        order = Window.partitionBy(*above).orderBy(F.col("cap") / F.col("weight"), *keys)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_open", F.sum("weight").over(after))
        full = F.col("cap") * F.col("_open") <= F.col("weight") * (F.col("_budget") - F.col("_used"))
        nodes = nodes.withColumn("_full", full)
        whole = Window.partitionBy(*above)
        kept = F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0))
        rest = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole)
        share = F.expr("((_budget - _kept) * weight) div _rest")
        nodes = nodes.withColumn("_kept", kept).withColumn("_rest", rest)
        parent = nodes.select(*keys, F.when(F.col("_full"), F.col("cap")).otherwise(share).alias("given"))
        above = keys
    return parent


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping] | None = None,
    budget: float = 0.6,
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``docs`` chosen by the mix, with ``n_tokens`` and ``epoch`` (from 0; names that ``docs`` has get a ``_``).

    ``levels`` maps level names to expressions over ``docs``, ``weights`` maps level names to
    whole-number weights of values (1 where absent), ``budget`` is a share of all tokens.
    """
    own = [f"level_{i}" for i in range(len(levels))]
    tokens_name, epoch_name = fresh(docs, "n_tokens", "epoch")
    # the row is one column, so that names of its columns clash with none here
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"),
        *[e.alias(n) for n, e in zip(own, levels.values(), strict=True)],
        words_between_spaces(F.col(text_col)).alias("n"),
    )
    leaves = materialize(named.groupBy(*own).agg(F.sum("n").alias("tokens")), "leaves")
    by_level = {n: (weights or {}).get(k, {}) for n, k in zip(own, levels, strict=True)}
    given = allocate(leaves, own, by_level, F.floor(F.sum("tokens") * F.lit(budget)).cast("long"), max_epochs)
    plan = leaves.alias("l").join(given.alias("g"), _same_named("l", "g", own)).select(
        *[F.col(f"l.{k}").alias(k) for k in own], F.expr("given div tokens").alias("whole"), F.expr("given % tokens").alias("rest")
    )
    plan = materialize(plan.withColumn("last", F.lit("")).withColumn("before", F.lit(0).cast("long")), "plan")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("whole").cast("string"), F.lit(":"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    terms = ["whole", "rest", "last", "before"]
    run = Window.partitionBy(*own).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for size in range(DIGITS, DIGITS * ROUNDS + 1, DIGITS):
        # sums of at most 16 ** DIGITS buckets a leaf say in which one its prefix ends, and after how many tokens that starts
        planned = _planned(named, plan, own, terms, order)
        inside = planned.where(F.substring("order", 1, size - DIGITS) == F.col("last")) if size > DIGITS else planned
        sums = inside.groupBy(*own, *terms, F.substring("order", 1, size).alias("bucket")).agg(F.sum("n").alias("sum"))
        over = sums.withColumn("run", F.col("before") + F.sum("sum").over(run)).where(F.col("run") > F.col("rest"))
        first = F.min(F.struct(F.col("bucket").alias("last"), (F.col("run") - F.col("sum")).alias("before"))).alias("end")
        ends = over.groupBy(*own, "whole", "rest").agg(first)
        plan = materialize(ends.select(*own, "whole", "rest", "end.last", "end.before"), "ends")
    decided = _planned(named, plan, own, terms, order).withColumn("bucket", F.substring("order", 1, DIGITS * ROUNDS))
    sure = decided.where("bucket <> last").withColumn("more", (F.col("bucket") < F.col("last")).cast("int"))
    inner = Window.partitionBy(*own).orderBy("order", "id", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = decided.where("bucket = last")
    border = border.withColumn("more", (F.col("before") + F.sum("n").over(inner) <= F.col("rest")).cast("int"))
    chosen = sure.unionByName(border).withColumn("epochs", (F.col("whole") + F.col("more")).cast("int")).where("epochs > 0")
    epochs = F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias(epoch_name)
    return chosen.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("n").alias(tokens_name), epochs)


def _planned(named: DataFrame, plan: DataFrame, own: Sequence[str], terms: Sequence[str], order: Column) -> DataFrame:
    """The rows with their leaf's terms and their place in its order."""
    joined = named.alias("d").join(plan.alias("p"), _same_named("d", "p", own))
    return joined.select("row", "id", *[F.col(f"d.{k}").alias(k) for k in own], "n", *terms).withColumn("order", order)


def _same_named(a: str, b: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def source_domain(source: str = "source") -> Column:
    """Domain of a source of the test tables: its number modulo 4, or -1 without one."""
    return F.coalesce(F.expr(f"try_cast(substring({source}, 4) as int) % 4"), F.lit(-1))
