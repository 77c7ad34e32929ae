"""Token counts by rank-synchronous merging of ragged symbol arrays.

Texts are cut into chunks that the pre-tokenizer can never join (single spaces between other
characters), each distinct chunk is counted once per Python worker, and the counts are summed.
Distinct chunks are pre-tokenized, laid out as one flat array of byte symbols with sequence
offsets, and merged together: in each round every sequence applies its own lowest-rank pair at
all places where it occurs, until no sequence holds a known pair. The symbols left are its tokens.

Null texts count as empty, empty texts have no tokens, very long texts are handled whole, repeated
rows repeat their result, and an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfabric.llm._words import WordCache, lean
from wayfabric.scratch import small_batches

NONE = np.iinfo(np.int64).max
# Fixed value: the published pre-tokenizer pattern of this byte-level vocabulary, with white space by property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: White space around a space, or a space at either end: the text is pre-tokenized as a whole.
_UNSAFE = re.compile(r"\s \s|  |^ | $|\A \s|[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Merges many byte sequences at once by the ranks of a byte-pair vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.of_byte = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of ``sequences``."""
        out = np.zeros(len(sequences), dtype=np.int64)
        sizes = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        owner = np.repeat(np.arange(len(sequences)), sizes)
        symbols = self.of_byte[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        while len(symbols):
            rank = np.full(len(symbols), NONE)
            joined = owner[1:] == owner[:-1]
            rank[:-1][joined] = self._rank(symbols[:-1][joined], symbols[1:][joined])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            out[owner[starts[done]]] = lengths[done]
            best_here = np.repeat(best, lengths)
            hit = (rank == best_here) & (best_here != NONE)
            # a pair of equal symbols may overlap itself: of a run of hits every second one counts
            where = np.flatnonzero(hit)
            if len(where):
                fresh = np.r_[True, np.diff(where) != 1]
                run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - run_start) % 2 == 0]
            symbols = symbols.copy()
            symbols[where] = self.made[rank[where]]
            keep = best_here != NONE
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


class TokenCounter:
    """Counts tokens of texts as the published vocabulary file defines them."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._merger = RankMerger(spec["model"]["vocab"], spec["model"]["merges"])
        self._find = regex.compile(PATTERN).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._chunks = WordCache(self._count_chunks)
        self._pieces = WordCache(lambda p: self._merger.count([x.encode() for x in p]).tolist())

    def _count_chunks(self, chunks: list[str]) -> list[int]:
        split = [self._find(" " + c) for c in chunks]
        return self._sums(split)

    def _sums(self, split: list[list[str]]) -> list[int]:
        self._pieces.ensure({p for s in split for p in s})
        get = self._pieces.__getitem__
        return [sum(map(get, s)) for s in split]

    def _plain(self, parts: list[str]) -> list[int]:
        whole = [i for i, t in enumerate(parts) if _UNSAFE.search(t)]
        chunked = [t.split(" ") for t in parts]
        for i in whole:
            chunked[i] = [""]
        self._chunks.ensure({c for t in chunked for c in t[1:]})
        heads = self._sums([self._find(t[0]) for t in chunked])
        get = self._chunks.__getitem__
        out = [h + sum(map(get, t[1:])) for h, t in zip(heads, chunked, strict=True)]
        if whole:
            for i, n in zip(whole, self._sums([self._find(parts[i]) for i in whole]), strict=True):
                out[i] = n
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a special string inside a text is one token, a null text has none."""
        texts = [t or "" for t in texts]
        if self._special is None:
            return self._plain(texts)
        parts, owner, extra = [], [], []
        for i, t in enumerate(texts):
            cut = self._special.split(t)
            parts += cut
            owner += [i] * len(cut)
            extra.append(len(cut) - 1)
        out = extra
        for i, n in zip(owner, self._plain(parts), strict=True):
            out[i] += n
        return out


_COUNTERS: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) for every row of ``docs``; one narrow pass, no shuffle."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    @lean("token_counts")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(path)
        if counter is None:
            counter = _COUNTERS[path] = TokenCounter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                n = np.array(counter.counts(texts), dtype=np.int64)
                size = np.array([len(t.encode()) if t else 0 for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = picked.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
