"""Language identification: script ranges narrow the candidates, Viterbi labels the words.

A model holds, for each language, hashed counts of the character 1- to 3-grams and of whole words,
summed over every training row, and the scripts that the language writes. A word's candidates are
the languages of its script; its score under each is its naive-Bayes log likelihood. Viterbi over
a text's words pays a fixed penalty for each change of language, so foreign words inside a span
keep the span's label while a longer foreign passage gets its own. A text's language is the one
whose spans hold most words with letters.

Null texts and texts without a letter are ``und`` with score 0, as is everything when there is no
training row. Rows with null text or language teach nothing. Ties go to the language that sorts
first. Very long texts are labelled whole. Repeated rows repeat their result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfabric.llm._words import lean
from wayfabric.scratch import small_batches

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Rows whose words are coded together.
ROWS = 1000
PENALTY = 12.0
SMOOTHING = 0.5
LEAST_SCRIPT_SHARE = 0.01
# First code points of blocks and the script written from there on.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
_LETTERS = re.compile(r"[^\W\d_]+").findall


def letters(word: str) -> str:
    """A word's letters, lower case."""
    return "".join(_LETTERS(word)).lower()


def scripts_of(cores: list[str]) -> np.ndarray:
    """Index in SCRIPTS of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in cores), dtype=np.int64, count=len(cores))
    return _SCRIPT_OF[np.searchsorted(_STARTS, first, side="right") - 1]


def features(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its marked form's 1- to 3-grams and the form itself, hashed: (word numbers, buckets)."""
    code = np.frombuffer("".join(f"^{w}$" for w in cores).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, cores), dtype=np.int64, count=len(cores)) + 2
    owner = np.repeat(np.arange(len(cores)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        k1, k2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        grams, owners = [], []
        key = code
        for n in (1, 2, 3):
            if n > 1:
                key = key[:-1] * k1 + code[n - 1 :]
            inside = owner[: len(key)] == owner[n - 1 :]
            grams.append(_scramble(key[inside] * k2 + np.uint64(n)))
            owners.append(owner[: len(key)][inside])
        whole = np.zeros(len(cores), dtype=np.uint64)
        np.add.at(whole, owner, _scramble(code * k1 + place.astype(np.uint64)))
        grams.append(_scramble(whole))
        owners.append(np.arange(len(cores)))
    return np.concatenate(owners), (np.concatenate(grams) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The lettered words of all texts as codes, the words' letters, and each text's end in the codes."""
    words = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
    coded = words.flatten().dictionary_encode()
    cores = [letters(w) for w in coded.dictionary.to_pylist()]
    lettered = np.fromiter(map(bool, cores), dtype=bool, count=len(cores))
    number = np.cumsum(lettered) - 1
    code = coded.indices.to_numpy()
    keep = lettered[code]
    return number[code[keep]], [c for c in cores if c], np.r_[0, np.cumsum(keep)][ends]


def learn(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit a model on all rows of ``train``; what reaches the driver is bounded by languages x buckets."""
    small_batches(train.sparkSession)

    @lean("lang_id")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                code, cores, ends = coded_words(part.column(0))
                if not cores:
                    continue
                langs = np.array(part.column(1).to_pylist(), dtype=object)
                names, which = np.unique(langs.astype(str), return_inverse=True)
                of_word = np.repeat(which, np.diff(np.r_[0, ends]))
                owner, bucket = features(cores)
                script = BUCKETS + scripts_of(cores)
                for k, name in enumerate(names.tolist()):
                    seen = np.bincount(code[of_word == k], minlength=len(cores))
                    new = np.bincount(bucket, weights=seen[owner], minlength=BUCKETS + len(SCRIPTS))
                    new += np.bincount(script, weights=seen, minlength=len(new))
                    total[name] = total.get(name, 0) + new.astype(np.int64)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"]
            )

    rows = (
        train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .where("text is not null and lang is not null")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(rows["lang"].unique().tolist())
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    counts[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return LanguageModel(langs, counts)


class LanguageModel:
    """Word scores by language and the span decoder."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
        total = grams.sum(axis=1, keepdims=True)
        self.log_p = np.log((grams + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.writes = share >= LEAST_SCRIPT_SHARE

    def word_scores(self, cores: list[str]) -> np.ndarray:
        """Log likelihoods (words x languages) less each word's best; languages of other scripts lose."""
        out = np.zeros((len(cores), len(self.langs)), dtype=np.float32)
        for at in range(0, len(cores), 20_000):
            part = cores[at : at + 20_000]
            owner, bucket = features(part)
            for k in range(len(self.langs)):
                out[at : at + len(part), k] = np.bincount(owner, weights=self.log_p[k][bucket], minlength=len(part))
        may = self.writes[:, scripts_of(cores)].T
        known = may.any(axis=1)
        low = np.where(may, out, np.inf).min(axis=1, initial=np.inf) - 4 * PENALTY
        out = np.where(may, out, np.where(known, low, 0)[:, None])
        out[~known] = 0
        return out - out.max(axis=1, keepdims=True)

    def table(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each text its lettered words as rows of the score matrix."""
        code, cores, ends = coded_words(pa.array(texts, pa.string()))
        return np.split(code, ends[:-1]) if len(ends) else [], self.word_scores(cores) if cores else np.zeros((0, len(self.langs)))

    def label(self, texts: list[str], penalty: float = PENALTY) -> list[np.ndarray]:
        """For each text the language index of each lettered word, by Viterbi."""
        index, scores = self.table(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        open_, flat_scores = [], []
        for i, ix in enumerate(index):
            s = scores[ix]
            if not len(ix):
                out[i] = np.zeros(0, dtype=np.int64)
                continue
            best = int(s.sum(axis=0).argmax())
            gain = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)
            low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
            low = np.vstack([np.zeros((1, s.shape[1])), low[:-1]])
            # no stretch of words gains half a switch by another label: the whole text keeps one
            if (gain - low).max() <= penalty / 2:
                out[i] = np.full(len(ix), best)
            else:
                open_.append(i)
                flat_scores.append(s)
        for i, path in zip(open_, viterbi(flat_scores, penalty), strict=True):
            out[i] = path
        return out  # type: ignore[return-value]

    def spans(self, text: str, penalty: float = PENALTY) -> list[tuple[str, int, int]]:
        """Labelled spans (language, first word, words) over the text's lettered words."""
        path = self.label([text], penalty)[0]
        if not len(path):
            return []
        cut = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        return [(self.langs[path[a]], int(a), int(n)) for a, n in zip(cut, np.diff(np.r_[cut, len(path)]), strict=True)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (the share of words in its spans) of each text."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        names, scores = [], []
        for path in self.label([t or "" for t in texts]):
            if not len(path):
                names.append("und")
                scores.append(0.0)
                continue
            n = np.bincount(path, minlength=len(self.langs))
            names.append(self.langs[int(n.argmax())])
            scores.append(float(n.max() / n.sum()))
        return names, scores


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label paths of several sequences; a change of label costs ``penalty``. Ties keep the label."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    while order:
        longest = len(scores[order[0]])
        group, order = order[: max(1, 500_000 // max(longest, 1))], order[max(1, 500_000 // max(longest, 1)) :]
        sizes = np.array([len(scores[i]) for i in group])
        width = scores[group[0]].shape[1]
        padded = np.zeros((longest, len(group), width))
        for j, i in enumerate(group):
            padded[: sizes[j], j] = scores[i]
        live = [int(n) for n in np.searchsorted(-sizes, -np.arange(longest), side="left")]
        value = padded[0].copy()
        stay = np.ones((longest, len(group), width), dtype=bool)
        jump = np.zeros((longest, len(group)), dtype=np.int16)
        for t in range(1, longest):
            m = live[t]
            best = value[:m].max(axis=1, keepdims=True) - penalty
            jump[t, :m] = value[:m].argmax(axis=1)
            stay[t, :m] = value[:m] >= best
            value[:m] = np.maximum(value[:m], best) + padded[t, :m]
        state = value.argmax(axis=1)
        path = np.zeros((longest, len(group)), dtype=np.int64)
        rows = np.arange(len(group))
        for t in range(longest - 1, -1, -1):
            m = live[t]
            path[t, :m] = state[:m]
            if t:
                state[:m] = np.where(stay[t, rows[:m], state[:m]], state[:m], jump[t, :m])
        for j, i in enumerate(group):
            out[i] = path[: sizes[j], j]
    return out


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score) for every row of ``docs``; one narrow pass."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean("lang_id")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"]
                )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, least_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language and whose spans of it hold at least ``least_share`` of the words."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @lean("lang_id")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                names, scores = shared.value.predict(part.column(at).to_pylist())
                keep = [n != "und" and s >= least_share for n, s in zip(names, scores, strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train_rows(docs: DataFrame, id_col: str = "doc_id", folds: int = 4, held: int = 2) -> DataFrame:
    """Rows that may teach: those whose id's checksum leaves another remainder than ``held``."""
    return docs.where(F.crc32(F.col(id_col).cast("string")) % folds != held)
