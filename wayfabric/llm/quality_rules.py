"""Quality rules: base counts, and a linear-chain CRF that marks lines as content or boilerplate.

Words are maximal runs of characters other than the six ASCII white-space characters. A document
fails the base rules if it has under 10 words or if words inside repeated 5-word windows make up
more than a fifth. Otherwise its lines are labelled by Viterbi decoding of a two-label chain, and
the document is kept if content lines hold at least ``KEEP_SHARE`` of its words.

The chain is trained by maximum likelihood on lines with provisional labels (``provisional``) of a
bounded number of documents, the first by a hash of their ids; labels.quality is not used. The labels
come from a rule that sees phrases, copies of lines and thresholds; the chain's features hold none of
these, only shares, sizes, places and hashed words, and what lies between two lines is decided by the
changes that it learned. Null texts count as empty and fail the base rules; texts of blank lines too.
Very long texts are read whole; repeated rows repeat their result; an empty table gives an empty
result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfabric.llm._words import lean
from wayfabric.scratch import small_batches

#: Bound of the documents whose lines train the chain.
TRAIN_LIMIT = 3000
KEEP_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
MARKS = "!#*$%&|"
_LEGAL = re.compile(r"licen[sc]e|copyright|all rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|sign up|log ?in\b", re.I)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    size = len(ids)
    if size == n:
        return 0
    key = code
    for k in range(1, width):
        key = key[:-1] * size + code[k:]
        _, key = np.unique(key, return_inverse=True)
    twice = np.bincount(key)[key] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[:-width] += twice
    edge[width:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    filled = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    return len(words), chars, symbols, len(filled) - len(set(filled)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    """Whether the base rules reject a text."""
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


@functools.lru_cache(maxsize=200_000)
def _word(word: str) -> tuple[int, bool, bool, bool, bool]:
    """Of a word: its bucket, whether it is all capitals, ends in a mark, starts with a capital, and holds a digit."""
    bare = word.lower().strip(".,;:!?'\"()")
    digit = any(map(str.isdigit, word))
    return zlib.crc32(bare.encode("utf-8", "surrogatepass")) % BUCKETS, word.isupper() and len(word) > 1, word[-1] in MARKS, word[0].isupper(), digit


def split_lines(text: str) -> list[list[str]]:
    """The words of the lines that have any."""
    return [x for x in (y.split() for y in text.split("\n")) if x]


def line_table(lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and numbers of words of lines."""
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    if not len(lines):
        return np.zeros((0, WIDTH)), sizes
    words = list(chain.from_iterable(lines))
    known = np.array(list(map(_word, words)), dtype=np.int64)
    owner = np.repeat(np.arange(len(lines)), sizes)
    chars = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    first = np.cumsum(sizes) - sizes
    same = np.r_[False, [a == b for a, b in pairwise(words)]]
    same[first] = False
    total = np.bincount(owner, weights=chars)
    share = [np.bincount(owner, weights=x) / sizes for x in (known[:, 1], known[:, 2], known[:, 3], known[:, 4], same)]
    symbols = np.array([sum(map(" ".join(x).count, SYMBOLS)) for x in lines]) / total
    ends = np.array([x[-1][-1] in ".?!" for x in lines])
    edge = np.zeros(len(lines))
    edge[[0, -1]] = 1
    plain = [np.ones(len(lines)), *share, np.minimum(symbols * 10, 2), np.minimum(sizes, 50) / 50, sizes < 4, ends, edge, np.minimum(total / sizes, 20) / 10]
    bag = np.bincount(owner * BUCKETS + known[:, 0], minlength=len(lines) * BUCKETS).reshape(-1, BUCKETS)
    return np.column_stack([*plain, bag / np.sqrt(sizes)[:, None]]), sizes


PLAIN, BUCKETS = 12, 128
WIDTH = PLAIN + BUCKETS


def provisional(lines: list[list[str]]) -> np.ndarray:
    """Provisional labels of lines: 1 is boilerplate. The rule behind them is not seen by the chain."""
    times = Counter(map(tuple, lines))
    out = []
    for w in lines:
        n, body = len(w), " ".join(w)
        shout = sum(x.isupper() and len(x) > 1 for x in w) / n
        marked = sum(x[-1] in MARKS for x in w) / n
        repeats = sum(a == b for a, b in pairwise(w)) / max(n - 1, 1)
        symbols = sum(map(body.count, SYMBOLS)) / len(body)
        out.append((shout > 0.5 and n > 2) or marked > 0.3 or repeats > 0.3 or symbols > 0.05 or times[tuple(w)] > 1 or bool(_LEGAL.search(body)))
    return np.array(out, dtype=np.int64)


class LineChain:
    """A two-label linear-chain CRF: label scores linear in line features, one score per label change."""

    def __init__(self) -> None:
        self.w = np.zeros((WIDTH, 2))
        self.t = np.zeros((2, 2))

    def fit(self, tables: list[tuple[np.ndarray, np.ndarray]], steps: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> LineChain:
        """Maximum likelihood by Adam on all sequences of (features, labels), side by side with those of at least half their length."""
        batches: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for pair in sorted((x for x in tables if len(x[1])), key=lambda x: len(x[1]), reverse=True):
            if not batches or 2 * len(pair[1]) < len(batches[-1][0][1]):
                batches.append([])
            batches[-1].append(pair)
        if not batches:
            return self
        padded = [self._pad(b) for b in batches]
        total = sum(on.sum() for _, _, on in padded)
        moment = [np.zeros_like(self.w), np.zeros_like(self.t), np.zeros_like(self.w), np.zeros_like(self.t)]
        for step in range(1, steps + 1):
            parts = [self._gradients(*b) for b in padded]
            grads = [sum(g for g, _ in parts) / total + ridge * self.w, sum(g for _, g in parts) / total + ridge * self.t]
            for k, (param, g) in enumerate(zip((self.w, self.t), grads, strict=True)):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                moment[k + 2] = 0.99 * moment[k + 2] + 0.01 * g * g
                param -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(moment[k + 2] / (1 - 0.99**step)) + 1e-8)
        return self

    @staticmethod
    def _pad(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, one-hot provisional labels and a mask of sequences, the longest first."""
        longest, b = len(tables[0][1]), len(tables)
        x = np.zeros((longest, b, WIDTH))
        y = np.zeros((longest, b), dtype=np.int64)
        on = np.zeros((longest, b), dtype=bool)
        for j, (rows, labels) in enumerate(tables):
            x[: len(rows), j], y[: len(rows), j], on[: len(rows), j] = rows, labels, True
        return x, np.eye(2)[y] * on[..., None], on

    def _gradients(self, x: np.ndarray, one: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected minus seen line and change counts of padded sequences."""
        longest, b = on.shape
        pairs = on[1:]
        e = x @ self.w
        fwd, back = np.zeros((longest, b, 2)), np.zeros((longest, b, 2))
        fwd[0] = e[0]
        for t in range(1, longest):
            new = np.logaddexp(fwd[t - 1][:, :1] + self.t[0], fwd[t - 1][:, 1:] + self.t[1]) + e[t]
            fwd[t] = np.where(on[t][:, None], new, fwd[t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = back[t + 1] + e[t + 1]
            new = np.logaddexp(self.t[:, 0] + nxt[:, :1], self.t[:, 1] + nxt[:, 1:])
            back[t] = np.where(on[t + 1][:, None], new, 0)
        z = np.logaddexp(fwd[-1, :, 0], fwd[-1, :, 1])
        p = np.exp(np.minimum(fwd + back - z[None, :, None], 0)) * on[..., None]
        pair = fwd[:-1, :, :, None] + self.t + (e + back)[1:, :, None, :] - z[None, :, None, None]
        q = np.exp(np.minimum(pair, 0)) * pairs[..., None, None]
        return np.tensordot(x, p - one, axes=([0, 1], [0, 1])), q.sum(axis=(0, 1)) - np.einsum("tbi,tbj->ij", one[:-1], one[1:])

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """Best label sequence (1: boilerplate) by Viterbi; ties go to content."""
        if not len(rows):
            return np.zeros(0, dtype=np.int64)
        e = (rows @ self.w).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = e[0]
        back = []
        for e0, e1 in e[1:]:
            from0 = (0 if a + t00 >= b + t10 else 1, 0 if a + t01 >= b + t11 else 1)
            back.append(from0)
            a, b = max(a + t00, b + t10) + e0, max(a + t01, b + t11) + e1
        state = 0 if a >= b else 1
        path = [state]
        for step in reversed(back):
            state = step[state]
            path.append(state)
        return np.array(path[::-1])

    def content_share(self, text: str) -> float:
        """Share of a text's words that lie in content lines."""
        rows, sizes = line_table(split_lines(text))
        if not len(sizes):
            return 0.0
        return float(sizes[self.decode(rows) == 0].sum() / sizes.sum())


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_LIMIT) -> LineChain:
    """Train the chain on all lines of the ``limit`` different documents that come first by hash of id."""
    small_batches(docs.sparkSession)
    given = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    given = given.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    chosen = given.select("id", "key").distinct().orderBy(F.xxhash64("id"), "id", "key").limit(limit)

    @lean("quality_rules")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [split_lines(t) for t in batch.column(2).to_pylist()]
            x = [line_table(t)[0].astype(np.float32).ravel() for t in lines]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float32())), pa.array([provisional(t) for t in lines], pa.list_(pa.int64()))],
                names=["id", "key", "x", "y"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = given.join(F.broadcast(chosen), ["id", "key"]).dropDuplicates(["id", "key"])
    rows = rows.mapInArrow(run, f"id {kind}, key long, x array<float>, y array<long>").toPandas().sort_values(["id", "key"], kind="stable")
    return LineChain().fit([(np.asarray(x, dtype=np.float64).reshape(-1, WIDTH), np.asarray(y)) for x, y in zip(rows["x"], rows["y"], strict=True)])


def apply_rules(docs: DataFrame, chain: LineChain, id_col: str = "doc_id", text_col: str = "text", keep_share: float = KEEP_SHARE) -> DataFrame:
    """Rows (id, base counts, base_failed, kept, content_share) for every row; one narrow pass."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @lean("quality_rules")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)
            failed = [base_failed(int(n), int(r)) for n, r in counts[:, [0, 4]]]
            share = [0.0 if bad else shared.value.content_share(t) for t, bad in zip(texts, failed, strict=True)]
            kept = [not bad and s >= keep_share for bad, s in zip(failed, share, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(share, pa.float64())],
                names=["id", *names, "base_failed", "kept", "content_share"],
            )

    schema = f"id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, content_share double"
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
