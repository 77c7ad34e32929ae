"""Quality classifier: Bradley-Terry ranking on preference pairs, thresholded by score quantile.

Each labelled document of quality 1 is preferred over one of quality 0. A document's strength is a
linear function of its text features, and a pair's likelihood is the logistic function of the
strengths' difference, so fitting is logistic regression on feature differences. The threshold is
the quantile of the training strengths that misjudges fewest training labels, of those at ``EDGES``
even steps from the least to the greatest strength; strengths map to (0, 1) by a logistic curve that
puts the threshold at 0.3.

The fit sees every labelled row. Rows are dealt by a hash of their ids into shards of about ``SHARD``,
each row meets rows of its shard in ``PAIRS_EACH`` pairs and more, and every Newton step and count sums
over all shards; only sums reach the driver.
Null and empty texts have the features of an empty text. A null label teaches nothing; of several
labels of an id the largest holds. Without labels of both kinds every score is 0.5. Repeated rows
repeat their result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfabric.llm._words import lean
from wayfabric.scratch import materialize, small_batches

#: Labelled rows that are paired with each other.
SHARD = 2_000
#: Strengths at which the training errors are counted.
EDGES = 8_192
PAIRS_EACH = 6
RIDGE = 1e-3
CUT = 0.3
SYMBOLS = "#*$%&|<>!"


def line_features(line: str) -> tuple[float, float, float, float, int]:
    """Of a line: shares of shouted words, marked words, bars, and repeats; and its words."""
    words = line.split()
    n = len(words)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0
    shout = sum(w.isupper() and len(w) > 1 for w in words)
    marked = sum(w[-1] in "!#*$%&" for w in words)
    bars = words.count("|")
    repeats = sum(a == b for a, b in pairwise(words))
    return shout / n, marked / n, bars / n, repeats / max(n - 1, 1), n


def features(text: str | None) -> list[float]:
    """Numeric features of a text."""
    text = text or ""
    lines = [line_features(x) for x in text.split("\n")]
    total = sum(x[4] for x in lines)
    words = text.split()
    mean = [sum(x[k] * x[4] for x in lines) / max(total, 1) for k in range(4)]
    long_lines = [x for x in lines if x[4] >= 4]
    most = [max((x[k] for x in long_lines), default=0.0) for k in range(4)]
    size = max(len(text), 1)
    symbols = sum(map(text.count, SYMBOLS)) / size
    distinct = len(set(words)) / max(total, 1)
    chars = sum(map(len, words)) / max(total, 1)
    digits = sum(map(text.count, "0123456789")) / size
    filled = [x for x in text.split("\n") if x]
    dup = 1 - len(set(filled)) / max(len(filled), 1)
    out = [*mean, *most, symbols, digits, dup, distinct, chars / 10, math.log1p(total) / 10, total / max(len(filled), 1) / 50]
    bad = max(mean)
    steps = [float(bad > c) for c in (0.02, 0.05, 0.1, 0.2, 0.4)] + [float(max(most) > c) for c in (0.15, 0.3, 0.6)]
    return out + steps + [float(symbols > c) for c in (0.005, 0.02, 0.05)] + [float(total < c) for c in (5, 20, 50)]


WIDTH = len(features(""))


def with_features(docs: DataFrame, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    """Rows (id, extra..., features array)."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in [id_col, *extra])

    @lean("quality_classifier")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "features"]
            )

    picked = docs.select(id_col, *extra, F.col(text_col).alias("_text"))
    return picked.mapInArrow(run, f"{kinds}, features array<double>")


def pair_differences(x: np.ndarray, y: np.ndarray, pairs_each: int = PAIRS_EACH, seed: int = 7) -> np.ndarray:
    """(preferred - other) feature differences of seeded pairs; none without rows of both kinds."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros((0, x.shape[1]))
    rng = np.random.default_rng(seed)
    n = pairs_each * max(len(good), len(bad))
    return x[rng.choice(good, n)] - x[rng.choice(bad, n)]


def pair_sums(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of the logistic loss at weights ``w``: number of pairs, gradient and Hessian, summed, as one vector."""
    p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
    return np.concatenate([[len(diff)], diff.T @ (p - 1), ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Weights of least mean logistic loss, by Newton's method on the sums of all pairs; zeros without pairs."""
    w = np.zeros(width)
    for _ in range(25):
        found = sums(w)
        n = found[0]
        if not n:
            break
        grad = found[1 : width + 1] / n + RIDGE * w
        hess = found[width + 1 :].reshape(width, width) / n + RIDGE * np.eye(width)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, pairs_each: int = PAIRS_EACH, seed: int = 7) -> np.ndarray:
    """The weights of rows that are held as one array."""
    diff = pair_differences(x, y, pairs_each, seed)
    return newton(lambda w: pair_sums(diff, w), x.shape[1])


def least_errors(edges: np.ndarray, bad: np.ndarray, good: np.ndarray) -> float:
    """The edge below which calling labels 0 errs least, given the counts of both labels from each edge to the next."""
    errors = np.concatenate([[0], np.cumsum(good)[:-1]]) + bad.sum() - np.concatenate([[0], np.cumsum(bad)[:-1]])
    at = np.flatnonzero(errors == errors.min())
    return float(edges[at[len(at) // 2]])


class QualityModel:
    """A fitted ranking with its threshold; without labels of both kinds (no scale) every score is 0.5."""

    def __init__(self, mid: np.ndarray, spread: np.ndarray, weights: np.ndarray, threshold: float = 0.0, scale: float = 0.0):
        self.mid, self.spread, self.weights, self.threshold, self.scale = mid, spread, weights, threshold, scale

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mid) / self.spread @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores in (0, 1); 0.3 at the threshold."""
        if not self.scale:
            return np.full(len(x), 0.5)
        z = 4 * (self.strength(x) - self.threshold) / self.scale + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def shards(rows: DataFrame, id_col: str) -> DataFrame:
    """Labelled rows (id, _label, features) as shards (g, x, y) of raw arrays, each in the order of its ids."""
    spark = rows.sparkSession
    many = F.lit(max(1, rows.count() // SHARD))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def shard() -> pd.DataFrame:
            whole = pd.concat(held)
            x = np.array(whole["features"].tolist(), dtype=np.float64)
            return pd.DataFrame({"g": [int(whole["g"].iloc[0])], "x": [x.tobytes()], "y": [whole["_label"].to_numpy(dtype=np.int8).tobytes()]})

        for frame in frames:
            for g, part in frame.groupby("g", sort=True):
                if held and held[0]["g"].iloc[0] != g:
                    yield shard()
                    held = []
                held.append(part)
        if held:
            yield shard()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64(id_col), many)).repartition(parts, "g").sortWithinPartitions("g", id_col, "features")
    return dealt.select("g", "_label", "features").mapInPandas(run, "g long, x binary, y binary")


def summed(blocks: DataFrame, each: Callable[[int, np.ndarray, np.ndarray], np.ndarray], merge: Callable = np.add) -> np.ndarray | None:
    """``each(g, x, y)`` over all shards, merged in every task and then on the driver, in the order of the shards."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, first = None, 0
        for frame in frames:
            for g, x, y in frame[["g", "x", "y"]].itertuples(index=False):
                found = each(g, np.frombuffer(x).reshape(-1, WIDTH), np.frombuffer(y, dtype=np.int8))
                out, first = (found, g) if out is None else (merge(out, found), first)
        if out is not None:
            yield pd.DataFrame({"g": [first], "v": [out.astype(np.float64).tobytes()]})

    out = None
    for r in sorted(blocks.mapInPandas(run, "g long, v binary").collect()):
        out = np.frombuffer(r["v"]) if out is None else merge(out, np.frombuffer(r["v"]))
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on all labelled rows; texts stay where they are, their features meet the labels."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    rows = materialize(with_features(docs.where(F.col(id_col).isNotNull()), id_col, text_col, []).join(chosen, id_col), "labelled")
    blocks = materialize(shards(rows, id_col), "shards")
    blank = QualityModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH))
    seen = summed(blocks, lambda g, x, y: np.concatenate([[(y == 0).sum(), (y == 1).sum(), len(x)], x.sum(axis=0)]))
    if seen is None or not seen[0] or not seen[1]:
        return blank
    n, mid = seen[2], seen[3:] / seen[2]
    spread = np.sqrt(summed(blocks, lambda g, x, y: ((x - mid) ** 2).sum(axis=0)) / n) + 1e-6
    weights = newton(lambda w: summed(blocks, lambda g, x, y: pair_sums(pair_differences((x - mid) / spread, y, seed=7 + g), w)), WIDTH)

    def strength(x: np.ndarray) -> np.ndarray:
        return (x - mid) / spread @ weights

    least, most = -summed(blocks, lambda g, x, y: -strength(x).min(keepdims=True), np.maximum)[0], summed(blocks, lambda g, x, y: strength(x).max(keepdims=True), np.maximum)[0]
    edges = np.linspace(least, most, EDGES + 1)

    def counts(g: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = strength(x)
        at = np.clip(np.searchsorted(edges, s, side="right") - 1, 0, EDGES)
        return np.concatenate([np.bincount(at[y == k], minlength=EDGES + 1) for k in (0, 1)] + [[s.sum(), (s * s).sum()]])

    found = summed(blocks, counts)
    bad, good = found[: EDGES + 1], found[EDGES + 1 : 2 * EDGES + 2]
    scale = float(np.sqrt(max(found[-1] / n - (found[-2] / n) ** 2, 0.0))) or 1.0
    return QualityModel(mid, spread, weights, least_errors(edges, bad, good), scale)


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, predicted) for every row of ``docs``; one narrow pass."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean("quality_classifier")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], dtype=np.float64).reshape(-1, WIDTH)
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["id", "score", "predicted"]
            )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
