"""Exact removal of repeated byte strings with suffix arrays over content-defined shards.

Every ``length``-byte string that starts at two places, in one text or in two, is found and the
bytes it covers are removed at each of its places.

1. Each text's windows of ``length`` bytes choose an anchor, the ``GRAM``-byte string of smallest hash
   inside the window (leftmost on ties). Equal windows choose equal anchors, so only texts' spans
   around one anchor need comparing, and anchors that occur once are done with. Equal texts, and equal
   spans of an anchor, are counted once, with their numbers of copies, before they are compared.
2. The spans of the anchors left are dealt by anchor into shards, with their numbers. Each shard builds a
   suffix array by Larsson-Sadakane refinement (rank doubling of the groups that are not yet sorted)
   and common prefix lengths by Kasai's method, run over all spans in lockstep; neighbours that share
   ``length`` bytes are one class of windows, which repeats if its spans occur twice in all. The
   repeats of a text that has no equal are found in no other way.
3. An anchor with more than ``SPLIT`` different spans is split over several shards, and their results are
   merged: each shard hands on one span part for each maximal run of windows that it holds first, cut
   where a second, longer anchor changes. Parts whose longer anchor occurs in one shard only are done
   with; where over ``SPLIT`` parts still share one, they are cut again by a longer one (``LONGER``), at
   last as long as the window. The parts left of each shard are sorted by a suffix array, and the
   sorted lists are merged by binary search of one list's windows in the other's.

Texts are identified by 128-bit hashes with their smallest id; spans by a 64-bit hash of the span
within a 64-bit hash of the anchor. What is merged across shards are bytes.

Null texts count as empty, texts shorter than ``length`` lose nothing, rows may repeat and ids may be
null: repeated rows are copies of each other. Very long texts are handled whole. An empty table
gives an empty result; extra columns, whatever their names, are ignored or (``cut_texts``) pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfabric.llm._names import fresh
from wayfabric.llm._words import lean
from wayfabric.scratch import discard, free, materialize, small_batches, spark_read, write_scratch

LENGTH = 200
GRAM = 48
#: Bytes of text whose windows are hashed together, and of spans that share a suffix array.
BLOCK = 1 << 20
SHARD = 1 << 20
#: Spans of one anchor beyond which it is split over several shards, and parts beyond which they are cut again.
SPLIT = 2000
#: Sizes of the longer anchors, as shares of the way from GRAM to the window.
LONGER = (0.5, 0.75, 0.875, 1.0)
#: Bits of an anchor's hash that decide which string of a window is smallest; the others hold its place.
CHOICE_BITS = 32
#: Tasks over which the texts of a span that very many texts hold are dealt.
DEAL = 32
NO_ID = -(1 << 63)
#: Bits of a symbol (0 to 257: past the end, separator, bytes) and symbols that fit one integer.
BITS, KEY = 9, 7
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes that start at each place, by doubling; shorter by gram - 1."""
    with np.errstate(over="ignore"):
        power, base = data.astype(np.uint64) + np.uint64(1), _MUL
        have, out, done = 1, None, 0
        n = len(data)
        while True:
            if gram & have:
                if out is None:
                    out, done, out_base = power, have, base
                else:  # out covers `done` bytes first, then power's `have`
                    m = n - done - have + 1
                    out = out[:m] * base + power[done : done + m]
                    done, out_base = done + have, out_base * base
            have *= 2
            if have > gram:
                return _mix(out)
            m = len(power) - have // 2
            power = power[:m] * base + power[have // 2 : have // 2 + m]
            base = base * base


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: anchor hashes, first bytes and sizes of the spans whose windows chose them."""
    none = np.zeros(0, dtype=np.int64)
    out = [(none, none, none)] * len(texts)
    group: list[int] = []
    size = 0
    for i, t in enumerate([*texts, None]):
        if t is not None and len(t) >= length:
            group.append(i)
            size += len(t)
        if group and (t is None or size >= BLOCK):
            _block_anchors(texts, group, out, length, gram)
            group, size = [], 0
    return out


def _block_anchors(texts: list[bytes], group: list[int], out: list, length: int, gram: int) -> None:
    data = np.frombuffer(b"".join(texts[i] for i in group), dtype=np.uint8)
    sizes = np.array([len(texts[i]) for i in group], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    grams = gram_hashes(data, gram)
    place_bits = np.uint64(64 - CHOICE_BITS)  # a fixed width, so that equal windows choose alike in any block
    key = ((grams >> place_bits) << place_bits) | np.arange(len(grams), dtype=np.uint64)
    best = window_minimum(key, length - gram + 1)
    chosen = (best & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    change = np.flatnonzero(np.diff(chosen)) + 1
    for i, a, n in zip(group, first.tolist(), sizes.tolist(), strict=True):
        lo, hi = a, a + n - length + 1
        cuts = change[np.searchsorted(change, lo, side="right") : np.searchsorted(change, hi, side="left")]
        starts = np.r_[lo, cuts]
        stops = np.r_[cuts, hi]
        at = chosen[starts]
        out[i] = (grams[at].view(np.int64), starts - a, stops - starts + length - 1)


def packed(symbols: np.ndarray, past: int = 1) -> np.ndarray:
    """The ``KEY`` symbols from each place on in one integer, first symbol highest; 0 past the end, for ``past`` places more."""
    padded = np.r_[symbols.astype(np.int64) + 1, np.zeros(past + KEY, dtype=np.int64)]
    n = len(symbols) + past
    key = np.zeros(n, dtype=np.int64)
    for k in range(KEY):
        key = (key << BITS) | padded[k : k + n]
    return key


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order, by Larsson-Sadakane refinement.

    A suffix's rank is the last place of its group. In each round only the groups that are not yet
    single are sorted again, by the rank of the suffix that starts where the known prefix ends.
    """
    n, known = len(symbols), KEY
    key = packed(symbols)[:n]
    order = np.argsort(key)
    sorted_key = key[order]
    rank = np.zeros(n + 1, dtype=np.int32)  # 0 past the end

    def regroup(places: np.ndarray, who: np.ndarray, differs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Give the suffixes ``who`` at ``places`` their groups' last places; returns those of groups of two or more."""
        first = np.flatnonzero(np.r_[True, differs])
        size = np.diff(np.r_[first, len(who)])
        rank[who] = np.repeat(places[first + size - 1] + 1, size)
        many = np.repeat(size > 1, size)
        return places[many], who[many]

    if not n:
        return order
    open_, who = regroup(np.arange(n, dtype=np.int32), order, sorted_key[1:] != sorted_key[:-1])
    while len(open_):
        both = (rank[who].astype(np.int64) << 32) | rank[np.minimum(who + known, n)]
        by = np.argsort(both)
        who, both = who[by], both[by]
        order[open_] = who
        open_, who = regroup(open_, who, both[1:] != both[:-1])
        known *= 2
    return order


def kasai(symbols: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix (``depth`` at most) of suffixes with the ones sorted before them, indexed by place.

    Only the first ``sizes`` suffixes from each of ``starts`` are asked for; others count 0. Kasai's invariant (a suffix shares at most one symbol less than the suffix one place before it)
    holds along each span, as the suffixes are sorted to their ends; all spans advance together.
    """
    n = len(symbols)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    key = packed(symbols, depth + KEY)
    steps = [np.int64(1) << np.int64(BITS * k) for k in range(1, KEY)]
    common = np.zeros(n, dtype=np.int64)
    lanes = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[lanes], sizes[lanes]
    have = np.zeros(len(starts), dtype=np.int64)
    for k in range(int(sizes.max(initial=0))):
        m = int(np.searchsorted(-sizes, -k, side="left"))
        at = starts[:m] + k
        other = before[at]
        h = np.where(other >= 0, np.maximum(have[:m] - 1, 0), 0)
        live = np.flatnonzero((other >= 0) & (h < depth))
        while len(live):  # seven symbols a step: how many lead alike shows in the difference of their keys
            differ = key[at[live] + h[live]] ^ key[other[live] + h[live]]
            alike = np.where(differ == 0, KEY, 0)
            part = np.flatnonzero(differ)
            rest = differ[part]
            for step in steps:
                alike[part] += rest < step
            h[live] += alike
            live = live[alike == KEY]
            live = live[h[live] < depth]
        np.minimum(h, depth, out=h)
        have[:m] = h
        common[at] = h
    return common


def repeats_in_shard(spans: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the spans: span, offset, and the number of its class (equal windows), from 0."""
    sizes = np.array([len(s) for s in spans], dtype=np.int64)
    symbols = np.frombuffer(b"\0".join([*spans, b""]), dtype=np.uint8).astype(np.int16) + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols[starts + sizes] = 0
    order = suffix_array(symbols)
    count = np.maximum(sizes - length + 1, 0)
    common = kasai(symbols, order, starts, count, length)  # a window never shares its length with a shorter tail
    owner = np.repeat(np.arange(len(spans)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = starts[owner] + offset
    fresh = common[order] < length
    label = np.zeros(len(symbols), dtype=np.int64)
    label[order] = np.cumsum(fresh)
    return owner, offset, label[place]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _bytes(texts: pa.Array) -> list[bytes]:
    return pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()


def _digests(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text, of different seeds."""
    filled = F.coalesce(text, F.lit(""))
    return [F.xxhash64(filled), F.xxhash64(F.lit(LENGTH), filled)]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (did, t1, t2, text): ids without nulls, and 128 bits that equal texts share."""
    t1, t2 = _digests(F.col(text_col))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text"))


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per document without its text: (did, t1, t2, n_bytes, sha, h[], sh[], n[], at[][]).

    A span that a text repeats is listed once, with all its places, so periodic texts stay short.
    """

    @lean("substring_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            for row in range(0, batch.num_rows, 1000):
                part = batch.slice(row, 1000)
                texts = _bytes(part.column(3))
                h, sh, size, inner, outer, flat = [], [], [], [0], [0], []
                for t, (grams, starts, sizes) in zip(texts, anchors(texts, length, gram), strict=True):
                    cuts, sizes = starts.tolist(), sizes.tolist()
                    marks = [digest(t[x : x + n]) - (1 << 63) for x, n in zip(cuts, sizes, strict=True)]
                    grams = grams.tolist()
                    if len(set(grams)) == len(grams):  # as in most texts, no anchor repeats
                        h += grams
                        sh += marks
                        size += sizes
                        flat += cuts
                        inner += range(inner[-1] + 1, inner[-1] + len(cuts) + 1)
                    else:
                        places: dict[tuple[int, int, int], list[int]] = {}
                        for x, key in zip(cuts, zip(grams, marks, sizes, strict=True), strict=True):
                            places.setdefault(key, []).append(x)
                        for (g, m, n), where in places.items():
                            h.append(g)
                            sh.append(m)
                            size.append(n)
                            flat += where
                            inner.append(len(flat))
                    outer.append(len(h))
                ends = pa.array(outer, pa.int32())
                at_lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(flat, pa.int32()))
                lists = [pa.array(h, pa.int64()), pa.array(sh, pa.int64()), pa.array(size, pa.int32()), at_lists]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(k) for k in range(3)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                        *(pa.ListArray.from_arrays(ends, x) for x in lists),
                    ],
                    names=["did", "t1", "t2", "n_bytes", "sha", "h", "sh", "n", "at"],
                )

    kinds = "h array<long>, sh array<long>, n array<int>, at array<array<int>>"
    return docs.mapInArrow(run, f"did long, t1 long, t2 long, n_bytes long, sha string, {kinds}")


def _spans(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of wanted spans: rows (h, sh, salt, splits, copies, span)."""

    @lean("substring_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for i, raw in enumerate(_bytes(batch.column(0))):
                want = lists.slice(i, 1).flatten()
                cols = {f.name: c for f, c in zip(want.type, want.flatten(), strict=True)}
                cut = [raw[a : a + n] for a, n in zip(cols["a"].to_pylist(), cols["n"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [cols["h"], cols["sh"], cols["salt"], cols["splits"], cols["copies"], pa.array(cut, pa.binary())],
                    names=["h", "sh", "salt", "splits", "copies", "span"],
                )

    joined = docs.join(wanted, ["did", "t1", "t2"]).select("text", "want")
    return joined.mapInArrow(run, "h long, sh long, salt int, splits int, copies long, span binary")


def _batch(out: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))


_RANGE = {"h": pa.int64(), "sh": pa.int64(), "start": pa.int32(), "stop": pa.int32()}
#: A part of a span of a split anchor: its longer anchor ``g``, shard, place in the span, whether its windows repeat in its shard, bytes.
_PART = {"g": pa.int64(), "salt": pa.int32(), "h": pa.int64(), "sh": pa.int64(), "start": pa.int32(), "known": pa.bool_(), "part": pa.binary()}
_RANGE_ROW = "h long, sh long, start int, stop int"
_PART_ROW = "g long, salt int, h long, sh long, start int, known boolean, part binary"


def _longer(length: int, gram: int) -> list[int]:
    return [gram + round(share * (length - gram)) for share in LONGER]


def _cut_parts(rows: list[tuple], length: int, gram: int) -> list[tuple]:
    """Parts (as ``_PART``, without g) cut again where their anchors of ``gram`` bytes change."""
    out = []
    for (salt, h, sh, start, known, body), (grams, firsts, sizes) in zip(rows, anchors([r[-1] for r in rows], length, gram), strict=True):
        for g, x, n in zip(grams.tolist(), firsts.tolist(), sizes.tolist(), strict=True):
            out.append((g, salt, h, sh, start + x, known, body[x : x + n]))
    return out


def _shards(spans: DataFrame, length: int, gram: int) -> DataFrame:
    """Suffix arrays per shard: rows (h, sh, start, stop) and, of split anchors, parts to be merged.

    ``part`` is null in the first kind: repeated byte ranges of a span. A part holds windows of which its
    span is the first of the shard; ``known`` tells whether they repeat there.
    """
    kinds = _PART | {"stop": pa.int32()}
    longer = _longer(length, gram)[0]

    def solve(rows: dict[str, list]) -> pa.RecordBatch:
        spans = rows["span"]
        owner, offset, label = repeats_in_shard(spans, length)
        copies = np.array(rows["copies"], dtype=np.float64)  # a window occurs as often as its spans do
        twice = np.bincount(label, weights=copies[owner])[label] > 1 if len(label) else np.zeros(0, dtype=bool)
        first = np.zeros(len(label), dtype=bool)
        first[np.unique(label, return_index=True)[1]] = True
        cuts = np.searchsorted(owner, np.arange(len(spans) + 1))
        out: list[tuple] = []
        parts: list[tuple] = []
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            h, sh = rows["h"][i], rows["sh"][i]
            for x, y in zip(*_runs(twice[a:b]), strict=True):
                out.append((None, None, h, sh, int(x), None, None, int(y) + length - 1))
            if rows["splits"][i] > 1:
                for known in (False, True):
                    for x, y in zip(*_runs(first[a:b] & (twice[a:b] == known)), strict=True):
                        parts.append((rows["salt"][i], h, sh, int(x), known, spans[i][x : y + length - 1]))
        out += [(*p, None) for p in _cut_parts(parts, length, longer)]
        return _batch(out, kinds)

    @lean("substring_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "sh", "salt", "splits", "copies", "span"]
        held: dict[str, list] = {k: [] for k in names}
        size, last, span = 0, None, None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in names]
            for row in zip(*cols, strict=True):
                key = (row[0], row[2])
                if key != last and size >= SHARD:
                    yield solve(held)
                    held, size = {k: [] for k in names}, 0
                if (row[0], row[1]) == span:  # the same span, from a repeated row
                    continue
                last, span = key, (row[0], row[1])
                for k, v in zip(names, row, strict=True):
                    held[k].append(v)
                size += len(row[5])
        if size:
            yield solve(held)

    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spans.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", "sh")
    return dealt.mapInArrow(run, f"{_PART_ROW}, stop int")


def _again(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """Parts cut by anchors of ``gram`` bytes."""

    @lean("substring_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in _PART if k != "g"]
            yield _batch(_cut_parts(list(zip(*cols, strict=True)), length, gram), _PART)

    return parts.mapInArrow(run, _PART_ROW)


def merge_lists(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(merged, hits in a, hits in b) of two sorted lists of distinct windows, by binary search of b in a."""
    at = np.searchsorted(a, b)
    in_b = np.zeros(len(b), dtype=bool)
    inside = at < len(a)
    in_b[inside] = a[at[inside]] == b[inside]
    in_a = np.zeros(len(a), dtype=bool)
    in_a[at[in_b]] = True
    return np.insert(a, at[~in_b], b[~in_b]), in_a, in_b


def repeats_across(shards: list[list[bytes]], length: int = LENGTH) -> list[np.ndarray]:
    """For each shard and each window of its parts, in order: whether another shard holds it.

    A shard's windows are distinct. Its list is sorted by a suffix array, neighbouring lists merge by
    binary search until one list is left; a window met twice is marked in both lists and in what they come from.
    """
    lists, marks = [], []
    for parts in shards:
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        data = np.frombuffer(b"\0".join([*parts, b""]), dtype=np.uint8)
        starts = np.cumsum(sizes + 1) - sizes - 1
        symbols = data.astype(np.int16) + 1
        symbols[starts + sizes] = 0
        count = sizes - length + 1
        place = np.repeat(starts - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        number = np.full(len(symbols), -1, dtype=np.int64)
        number[place] = np.arange(len(place))
        order = number[suffix_array(symbols)]
        order = order[order >= 0]
        # a closing 1 keeps windows that end in zero bytes apart, which the comparison of fixed strings would cut
        window = np.ones((len(place), length + 1), dtype=np.uint8)
        window[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[place]
        lists.append(np.ascontiguousarray(window[order]).view(f"S{length + 1}").ravel())
        marks.append(order)
    hits = [np.zeros(len(x), dtype=bool) for x in lists]  # by sorted place
    groups = [(x, [i]) for i, x in enumerate(lists)]
    while len(groups) > 1:
        merged = []
        for (a, mine), (b, theirs) in zip(groups[::2], groups[1::2], strict=False):
            both, in_a, in_b = merge_lists(a, b)
            for whole, found, members in ((a, in_a, mine), (b, in_b, theirs)):
                met = whole[found]
                if len(met):
                    for i in members:
                        at = np.minimum(np.searchsorted(met, lists[i]), len(met) - 1)
                        hits[i] |= met[at] == lists[i]
            merged.append((both, mine + theirs))
        groups = merged + ([groups[-1]] if len(groups) % 2 else [])
    out = []
    for order, hit in zip(marks, hits, strict=True):
        back = np.zeros(len(hit), dtype=bool)
        back[order] = hit
        out.append(back)
    return out


def _merge(parts: DataFrame, length: int) -> DataFrame:
    """Windows of split anchors that are single in their shard and occur in another: rows (h, sh, start, stop)."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        by_shard: dict[int, list[tuple]] = {}
        for row in rows:
            by_shard.setdefault(row[1], []).append(row)
        shards = list(by_shard.values())
        out = []
        for mine, found in zip(shards, repeats_across([[r[6] for r in x] for x in shards], length), strict=True):
            at = 0
            for _, _, h, sh, start, known, body in mine:
                n = len(body) - length + 1
                if not known:
                    out += [(h, sh, start + int(x), start + int(y) + length - 1) for x, y in zip(*_runs(found[at : at + n]), strict=True)]
                at += n
        return _batch(out, _RANGE)

    @lean("substring_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in _PART), strict=True):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6]) * 4
        if held:
            yield solve(held)

    count = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(count, "g").sortWithinPartitions("g", "salt", "h", "sh", "start").mapInArrow(run, _RANGE_ROW)


def _across(parts: DataFrame, length: int, gram: int, split: int) -> DataFrame | None:
    """All that the merges across shards find, from level to level of longer anchors; None where no anchor was split."""
    found = None
    for longer in [*_longer(length, gram)[1:], None]:
        if parts.isEmpty():
            break
        ends = parts.groupBy("g").agg(F.min("salt").alias("low"), F.max("salt").alias("high"), F.count(F.lit(1)).alias("m"))
        crowded = F.col("m") > split if longer else F.lit(False)  # at the last level a shard lists a window once
        met = materialize(ends.where("low < high").select("g", crowded.alias("crowded")), "met")
        parts = materialize(parts.join(met, "g"), "parts")
        merged = materialize(_merge(parts.where("not crowded").drop("crowded"), length), "merged")
        found = merged if found is None else found.unionByName(merged)
        if longer:
            parts = materialize(_again(parts.where("crowded").drop("crowded"), length, longer), "parts")
    return found


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges) for ``docs`` (did, t1, t2, text), as ``keyed`` makes them.

    texts: one row per document (did, t1, t2, n_bytes, sha, copies). ranges: (did, t1, t2, ranges) for the
    texts that occur once and lose bytes, ``ranges`` an array of (start, stop) that may overlap.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = ["did", "t1", "t2"]
    full = write_scratch(_scan(docs, length, gram), "scan")
    scanned = materialize(spark_read(spark, full).select(*key, "n_bytes", "sha"), "marks")
    texts = spark_read(spark, full).groupBy("t1", "t2").agg(
        F.count(F.lit(1)).alias("copies"), F.min("did").alias("did"), F.first(F.struct("h", "sh", "n", "at")).alias("x")
    )
    listed = write_scratch(texts, "texts")
    discard(spark, full)
    free(spark)
    texts = spark_read(spark, listed)
    zipped = F.explode(F.arrays_zip("x.h", "x.sh", "x.n", "x.at")).alias("z")
    places = texts.select(*key, "copies", zipped).select(*key, "copies", "z.h", "z.sh", "z.n", "z.at")
    times = F.sum(F.col("copies") * F.size("at"))
    shared = materialize(places.groupBy("h").agg(times.alias("places")).where("places > 1").select("h"), "shared")
    found = materialize(places.join(shared, "h"), "found")
    copied = materialize(texts.where("copies > 1").select("t1", "t2", "copies"), "copied")
    discard(spark, listed)
    free(spark)

    first = F.min(F.struct(*key, F.col("at")[0].alias("a"), "n")).alias("at")
    variants = found.groupBy("h", "sh").agg(times.alias("copies"), F.count(F.lit(1)).alias("texts"), first)
    variants = materialize(variants, "variants")
    hot = variants.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > split)
    hot = materialize(hot.select("h", F.ceil(F.col("m") / split).cast("int").alias("splits")), "hot")
    salted = variants.join(hot, "h", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    salted = salted.withColumn("salt", F.pmod("sh", "splits").cast("int"))
    want = F.collect_list(F.struct("at.a", "at.n", "h", "sh", "salt", "splits", "copies")).alias("want")
    wanted = salted.groupBy("at.did", "at.t1", "at.t2").agg(want)
    solved = materialize(_shards(_spans(docs, wanted), length, gram), "solved")
    free(spark)
    pieces = solved.where("part is null").select("h", "sh", "start", "stop")
    across = _across(solved.where("part is not null").drop("stop"), length, gram, split)
    pieces = pieces if across is None else pieces.unionByName(across)
    ranges = materialize(_placed(found.where("copies = 1"), pieces, variants), "ranges")
    free(spark)
    return scanned.join(copied, ["t1", "t2"], "left").withColumn("copies", F.coalesce("copies", F.lit(1))), ranges


def _placed(found: DataFrame, pieces: DataFrame, variants: DataFrame) -> DataFrame:
    """The ranges of every text: (did, t1, t2, ranges).

    Spans of very many texts (each over a thousandth of all, so at most 1,000 spans) are joined with their
    pieces under several salts, so that no task gets all texts of one.
    """
    total = variants.agg(F.sum("texts")).first()[0] or 0
    often = variants.where(F.col("texts") > F.lit(max(total // 1000, 1))).select("h", "sh", F.lit(DEAL).alias("parts"))
    often = F.broadcast(often)
    parts = F.coalesce(F.col("parts"), F.lit(1))
    left = found.join(often, ["h", "sh"], "left").withColumn("deal", F.pmod(F.xxhash64("did", "t1"), parts).cast("int")).drop("parts")
    right = pieces.join(often, ["h", "sh"], "left").withColumn("deal", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    key = ["did", "t1", "t2"]
    rows = left.join(right, ["h", "sh", "deal"]).select(*key, F.explode("at").alias("a"), "start", "stop")
    rows = rows.select(*key, (F.col("a") + F.col("start")).alias("start"), (F.col("a") + F.col("stop")).alias("stop"))
    return rows.groupBy(*key).agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))


def _cut(raw: bytes, starts: list[int], stops: list[int]) -> tuple[bytes, int, int]:
    """What is left of ``raw`` without the ranges, the bytes removed and the number of removed runs."""
    edge = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), len(_runs(gone)[0])


def _range_lists(column: pa.ListArray, i: int) -> tuple[list[int], list[int]]:
    flat = column.slice(i, 1).flatten()
    return tuple(flat.field(k).to_pylist() for k in (0, 1)) if len(flat) else ([], [])  # type: ignore[return-value]


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256), one per row of ``docs``."""
    rows = keyed(docs, id_col, text_col)
    key = ["did", "t1", "t2"]
    texts, ranges = repeated_ranges(rows, length, split=split)

    @lean("substring_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"did": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
        for batch in batches:
            lists, out = batch.column(2), []
            for i, (did, raw) in enumerate(zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True)):
                kept, gone, spans = _cut(raw, *_range_lists(lists, i))
                out.append((did, len(raw), gone, spans, hashlib.sha256(kept).hexdigest()))
            yield _batch(out, kinds)

    schema = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = rows.join(ranges, key).select("did", "text", "ranges").mapInArrow(run, schema)
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    plain = texts.join(ranges.select(*key), key, "left_anti").select(
        "did",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        gone.cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    kind = docs.schema[id_col].dataType
    back = F.when(F.col("did") != NO_ID, F.col("did")).cast(kind).alias(id_col)
    return plain.unionByName(cut).select(back, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_texts(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut out of the text column; broken characters at cuts are dropped.

    Null texts stay null. Other columns pass through unchanged, under any name.
    """
    rows = keyed(docs, id_col, text_col)
    texts, ranges = repeated_ranges(rows, length)
    did, t1, t2, lists_name, whole_name = fresh(docs, "_did", "_t1", "_t2", "_ranges", "_whole")
    copied = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length))
    copied = copied.select(F.col("t1").alias(t1), F.col("t2").alias(t2)).distinct()
    first, second = _digests(F.col(text_col))
    keys = ranges.select(F.col("did").alias(did), F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("ranges").alias(lists_name))
    marked = docs.withColumn(did, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(t1, first).withColumn(t2, second)
    marked = marked.join(keys, [did, t1, t2], "left").join(copied.withColumn(whole_name, F.lit(True)), [t1, t2], "left")
    at = marked.columns.index(text_col)

    @lean("substring_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(lists_name))
            whole = batch.column(batch.schema.get_field_index(whole_name)).to_pylist()
            old = batch.column(at)
            out = []
            for i, raw in enumerate(_bytes(old)):
                if not old[i].is_valid:
                    out.append(None)
                elif whole[i]:
                    out.append("")
                else:
                    starts, stops = _range_lists(lists, i)
                    out.append(_cut(raw, starts, stops)[0].decode("utf-8", "ignore") if starts else raw.decode("utf-8", "ignore"))
            cols = list(batch.columns)
            cols[at] = pa.array(out, old.type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    changed = marked.mapInArrow(run, marked.schema)
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])
