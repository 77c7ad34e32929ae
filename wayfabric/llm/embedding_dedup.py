"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

Vectors are compared within a label by cosine in double precision. Each of ``tables`` hash functions
rotates the normalized vector (random signs and a fast Hadamard transform, three times) and takes
the nearest signed axis; ``depth`` independent rotations make one code, and multiprobing files the
vector under its ``probes`` best codes per table. The depth grows with the number of vectors of a label,
so that buckets keep a bounded expected size; each label has its own depth, and tables and probes grow
with it, so that deeper codes lose no links. Every pair that shares a bucket is verified exactly.

A pair may meet in several buckets; it is counted in the first one, by table and code, that both
share, which each bucket decides on its own from the codes that vectors carry along. Links are
counted inside buckets by blocked matrix products, and only counts and a spanning forest of the
links leave a bucket, so a group of near copies is not expanded into pairs. Equal vectors are one
class with a multiplicity from the start. Buckets above ``BLOCK`` classes are dealt into pairs of
tiles, whose work is shared by many tasks.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link
with nothing. Rows may repeat (equal vectors link with cosine 1). Null ids count as links of others
but name no component unless all ids are null. Vectors of different lengths do not link. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfabric.llm._words import lean
from wayfabric.operators.components import components_of_edges
from wayfabric.scratch import materialize

THRESHOLD = 0.93
TABLES = 4
PROBES = 3
#: Tables and probes of codes of each depth, as multiples of those of depth 1.
EFFORT = {1: (1, 1), 2: (1.5, 4 / 3), 3: (2, 2), 4: (3, 8 / 3)}
BLOCK = 1500
SEED = 2718


def rotations(width: int, count: int, seed: int = SEED) -> np.ndarray:
    """Random signs (count, 3, width) of the rotations."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(count, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (width a power of two), scaled to keep lengths."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def codes(x: np.ndarray, depth: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Codes (rows, tables, probes) of normalized rows; the first probe is the vector's own bucket.

    A probe's cost is what the rotated coordinates lose against the largest; for deeper codes one of the
    parts is exchanged, the cheapest exchanges first.
    """
    n, width = x.shape
    size = 1 << max(1, (width - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :width] = x
    signs = rotations(size, tables * depth)
    out = np.zeros((n, tables, probes), dtype=np.int64)
    for t in range(tables):
        best, loss, rank = [], [], []
        for k in range(depth):
            y = padded
            for s in signs[t * depth + k]:
                y = hadamard(y * s)
            both = np.concatenate([y, -y], axis=1)
            top = np.argpartition(-both, min(probes, both.shape[1] - 1), axis=1)[:, :probes]
            value = np.take_along_axis(both, top, axis=1)
            order = np.argsort(-value, axis=1, kind="stable")
            top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
            best.append(top)
            loss.append(value[:, :1] - value)
            rank.append(top[:, 0])
        base = np.zeros(n, dtype=np.int64)
        for k in range(depth):
            base = base * 2 * size + best[k][:, 0]
        out[:, t, 0] = base
        # exchanges of one part: (part, its j-th best), by loss
        price = np.concatenate([loss[k][:, 1:] for k in range(depth)], axis=1)
        change = np.concatenate([(best[k][:, 1:] - best[k][:, :1]) * (2 * size) ** (depth - 1 - k) for k in range(depth)], axis=1)
        pick = np.argsort(price, axis=1, kind="stable")[:, : probes - 1]
        out[:, t, 1:] = base[:, None] + np.take_along_axis(change, pick, axis=1)
    return out


def code_depth(vectors: int, width: int) -> int:
    """Rotations per code so that a bucket is expected to hold some tens of vectors of a label."""
    size = 2 << max(1, (width - 1).bit_length())
    depth = 1
    while vectors / size**depth > 64 and depth < 4:
        depth += 1
    return depth


def effort(depth: int, tables: int = TABLES, probes: int = PROBES) -> tuple[int, int]:
    """Tables and probes of codes of a depth, given those of depth 1."""
    more, wider = EFFORT[depth]
    return math.ceil(tables * more), math.ceil(probes * wider)


def _as_float(vectors: DataFrame, vec_col: str) -> Column:
    """The vectors as they are if of floats, else as doubles."""
    own = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    return F.col(vec_col) if own else F.col(vec_col).cast("array<double>")


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe from overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (vid, key or null), classes (cid, label, vec, m, least) of equal label and vector.

    Classes are numbered where they are written, not named by an id, so different vectors under one id stay apart.
    """
    ok = (
        F.col("vec").isNotNull()
        & (F.size("vec") > 0)
        & F.col("label").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    rows = vectors.select(F.col(id_col).alias("vid"), _as_float(vectors, vec_col).alias("vec"), F.col(label_col).alias("label"))
    plus = F.transform("vec", lambda x: x.cast("double") + F.lit(0.0))
    key = F.when(F.coalesce(ok, F.lit(False)), F.unhex(F.sha2(F.to_json(F.struct("label", plus.alias("v"))), 256)))
    rows = rows.withColumn("key", key)
    grouped = rows.where("key is not null").groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.min("vid").alias("least"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )
    return rows.select("vid", "key"), grouped.withColumn("cid", F.monotonically_increasing_id())


def with_depth(classes: DataFrame) -> DataFrame:
    """Adds the depth of each class, by the number of classes of its own label and vector length."""
    spark = classes.sparkSession
    sizes = classes.groupBy(F.size("vec").alias("w"), "label").count()
    # only labels of over 128 vectors per component can need more than one rotation
    large = sizes.where(F.col("count") > 128 * F.col("w")).collect()
    deep = [(r["w"], r["label"], code_depth(r["count"], r["w"])) for r in large]
    kind = classes.schema["label"].dataType.simpleString()
    known = spark.createDataFrame([r for r in deep if r[2] > 1], f"w int, label {kind}, depth int")
    rows = classes.withColumn("w", F.size("vec")).join(F.broadcast(known), ["w", "label"], "left")
    return rows.withColumn("depth", F.coalesce("depth", F.lit(1)))


def _coded(classes: DataFrame, tables: int, probes: int) -> DataFrame:
    """Rows (label, width, cid, m, vec, codes[], probes), one per class; table t holds codes t * probes and on."""

    @lean("embedding_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, m, lab, vecs = (batch.column(k) for k in range(4))
            depths = batch.column(4).to_numpy()
            flat, ends = vecs.flatten().to_numpy(), vecs.offsets.to_numpy() - vecs.offsets[0].as_py()
            width = np.diff(ends)
            for w, depth in np.unique(np.column_stack([width, depths]), axis=0).tolist():
                rows = np.flatnonzero((width == w) & (depths == depth))
                tabs, prob = effort(depth, tables, probes)
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    x = flat[ends[part][:, None] + np.arange(w)]
                    code = codes(unit_rows(x), depth, tabs, prob)
                    take, n = pa.array(part), len(part)
                    lists = [pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * z).astype(np.int32)), pa.array(v.ravel())) for z, v in ((w, x), (tabs * prob, code))]
                    sizes = [pa.array(np.full(n, z, dtype=np.int32)) for z in (w, prob)]
                    yield pa.RecordBatch.from_arrays(
                        [lab.take(take), sizes[0], cid.take(take), m.take(take), *lists, sizes[1]],
                        names=["label", "width", "cid", "m", "vec", "codes", "probes"],
                    )

    kind = classes.schema["label"].dataType.simpleString()
    vec = classes.schema["vec"].dataType.simpleString()
    schema = f"label {kind}, width int, cid long, m long, vec {vec}, codes array<long>, probes int"
    return with_depth(classes).select("cid", "m", "label", "vec", "depth").mapInArrow(run, schema)


def _filed(coded: DataFrame, *columns: str) -> DataFrame:
    """The ``columns`` of coded classes, once per bucket (label, width, tab, code)."""
    rows = coded.select("label", "width", "probes", *columns, F.posexplode("codes").alias("at", "code"))
    return rows.withColumn("tab", F.expr("cast(at div probes as int)")).drop("at")


def bucket_links(vec: np.ndarray, code: np.ndarray, tab: int, mine: int, probes: int, threshold: float, cut: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a bucket that meet here first; with ``cut``, of the first ``cut`` rows with the others."""
    a, b = (vec, vec) if cut is None else (vec[:cut], vec[cut:])
    i, j = np.nonzero(a @ b.T >= threshold - 1e-9)
    j = j + (cut or 0)
    one = i < j
    i, j = i[one], j[one]
    exact = np.einsum("ij,ij->i", vec[i], vec[j]) >= threshold
    i, j = i[exact], j[exact]
    first = np.ones(len(i), dtype=bool)
    for at in range(0, len(i), 20_000):
        x, y = code[i[at : at + 20_000]], code[j[at : at + 20_000]]
        met = np.zeros(len(x), dtype=bool)
        for t in range(tab + 1):
            p, q = x[:, t * probes : (t + 1) * probes], y[:, t * probes : (t + 1) * probes]
            same = p[:, :, None] == q[:, None, :]
            if t < tab:
                met |= same.any(axis=(1, 2))
            else:
                met |= (same & (p < mine)[:, :, None]).any(axis=(1, 2))
        first[at : at + 20_000] = ~met
    return i[first], j[first]


def _solve(dealt: DataFrame, threshold: float, keys: list[str], two_sided: bool) -> DataFrame:
    """Rows (cid, links, other): verified links per class and bucket, or a forest edge to another class."""

    def solve(rows: list) -> list[tuple[int, int, int | None]]:
        if two_sided:
            rows = sorted(rows, key=lambda r: r[5])
            cut = sum(r[5] == 0 for r in rows)
            if not 0 < cut < len(rows):
                return []
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        m = np.array([r[1] for r in rows], dtype=np.int64)
        vec, code = unit_rows(np.array([r[2] for r in rows])), np.array([r[3] for r in rows], dtype=np.int64)
        tab, mine, probes = rows[0][4]
        i, j = bucket_links(vec, code, tab, mine, probes, threshold, cut if two_sided else None)
        n = np.bincount(i, weights=m[j], minlength=len(ids)) + np.bincount(j, weights=m[i], minlength=len(ids))
        out = [(int(ids[k]), int(n[k]), None) for k in np.flatnonzero(n)]
        parent = list(range(len(ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[x] = y
                out.append((int(ids[a]), 0, int(ids[b])))
        return out

    @lean("embedding_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        last, found = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal found
            cols = list(zip(*found, strict=True)) or [[], [], []]
            found = []
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cid", "links", "other"])

        for batch in batches:
            get = {f: batch.column(batch.schema.get_field_index(f)) for f in batch.schema.names}
            key_rows = zip(*(get[k].to_pylist() for k in keys), strict=True)
            widths, vecs = get["width"].to_pylist(), get["vec"].flatten().to_numpy()
            code, ends = get["codes"].flatten().to_numpy(), get["codes"].offsets.to_numpy() - get["codes"].offsets[0].as_py()
            ids, ms, tabs, mine, probes = (get[k].to_pylist() for k in ("cid", "m", "tab", "code", "probes"))
            side = get["side"].to_pylist()
            at = 0
            for r, key in enumerate(key_rows):
                if key != last:
                    if len(held) > 1:
                        found += solve(held)
                    held, last = [], key
                    if len(found) > 100_000:
                        yield from flush()
                held.append((ids[r], ms[r], vecs[at : at + widths[r]].copy(), code[ends[r] : ends[r + 1]].copy(), (tabs[r], mine[r], probes[r]), side[r]))
                at += widths[r]
        if len(held) > 1:
            found += solve(held)
        yield from flush()

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "cid").mapInArrow(run, "cid long, links long, other long")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    probes: int = PROBES,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    block: int = BLOCK,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row of ``vectors``."""
    rows, grouped = _classes(vectors, id_col, vec_col, label_col)
    classes = materialize(grouped, "classes")
    coded = materialize(_coded(classes, tables, probes), "coded")
    bucket = ["label", "width", "tab", "code"]
    counts = _filed(coded).groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = materialize(counts.withColumn("tiles", F.ceil(F.col("n") / block).cast("int")).drop("n"), "counts")
    full = _filed(coded, "cid", "m", "vec", "codes").join(counts, bucket).withColumn("side", F.lit(0))
    found = materialize(_solve(full.where("tiles = 1"), threshold, bucket, False), "links")
    if not counts.where("tiles > 1").isEmpty():
        big = full.where("tiles > 1").withColumn("own", F.pmod(F.xxhash64("cid"), "tiles").cast("int"))
        inside = _solve(big.withColumn("tile", F.col("own")), threshold, [*bucket, "tile"], False)
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        pairs = big.withColumn("with", other).where("with <> own")
        pairs = pairs.withColumn("low", F.least("own", "with")).withColumn("high", F.greatest("own", "with"))
        pairs = pairs.withColumn("side", (F.col("own") > F.col("with")).cast("int"))
        across = _solve(pairs, threshold, [*bucket, "low", "high"], True)
        found = found.unionByName(materialize(inside.unionByName(across), "links"))
    links = found.where("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    comps = components_of_edges(edges).withColumnRenamed("node", "cid")
    linked = comps.join(classes.select("cid", "least"), "cid")
    names = linked.groupBy("component").agg(F.min("least").alias("name"))
    named = linked.join(names, "component").select("cid", "name").join(links, "cid")
    result = classes.select("cid", "key", "m", "least").join(named, "cid", "left")
    result = result.select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), F.coalesce("name", "least").alias("component_id")
    )
    out = rows.join(result, "key", "left").select(
        F.col("vid").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vid").cast("long").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
