"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens. Only the histogram of
piece lengths (at most ``capacity`` rows) reaches the driver. There the configuration program
"fewest sequences that cover every length" is solved by multiplicative weights: prices rise for
lengths that are covered least, a knapsack dynamic program over the prices finds the best next
configuration, and the configuration takes a share of the demand. The fractional amounts are
rounded down, what is left is placed best-fit, longest first, into the room of open sequences,
all on counts, so the work does not depend on the number of documents. Pieces then find their
place by their rank within their length: ranks are numbered per range partition and offset by
the partitions' counts, so that a length shared by a large part of the rows is dealt over tasks.
The token ids are written once with a number per piece; only lengths and numbers are sorted and
placed, and the ids join their places by that number.

Null texts count as empty: one piece holding the end id alone. Very long texts are cut, never
shortened. Rows repeat, and null ids occur: every row is a document of its own. An empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfabric.llm._words import WordCache, lean
from wayfabric.scratch import materialize, small_batches

CAPACITY = 4096
END_ID = 1
#: Chunks that are tokenized in one call.
JOINED = 400
#: Stops after a letter or digit of the Latin blocks. Some letters of other blocks, and the dotted capital I, end in a
#: mark once they are normalized, which the vocabulary joins with the stops that follow.
STOPS = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([.,;:!?]+)(\s|$)"
#: Lengths are rounded up to units of this many tokens while configurations are priced.
UNIT = 16
RATE = 0.25
#: Rounded configurations that leave more room than this are dissolved and placed best-fit.
WASTE = 0
CONFIGURATIONS = 600


class PieceEncoder:
    """Token ids as bytes, by the tokenizers library, with a cache over chunks between white space.

    The vocabulary's pre-tokenizer drops white space, its normalizer composes nothing across it and
    its special strings hold none, so chunks between spaces and line ends are encoded independently.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._cache = WordCache(self._encode)

    def _encode(self, words: list[str]) -> list[bytes]:
        """Many chunks in one call: joined by spaces, and cut again where the tokens' offsets say."""
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            found = self._tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.kind)
            starts = np.fromiter(chain.from_iterable(found.offsets), dtype=np.int64, count=2 * len(ids))[::2]
            ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1)
            raw, cut = ids.tobytes(), (ids.itemsize * np.searchsorted(starts, ends)).tolist()
            out += [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]
        return out

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of ``kind``."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        # the vocabulary is lower case; only the spelling of its special strings matters, and that capitals are
        # composed with the marks that follow them before they are lowered
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            marked = pc.match_substring_regex(texts, r"[A-Z]\p{M}") if not pc.all(pc.string_is_ascii(texts)).as_py() else None
            lower = pc.ascii_lower(texts)
            texts = lower if marked is None else pc.if_else(marked, texts, lower)
        # stops between a Latin letter or digit and white space are chunks of their own, as they are tokens of their own
        texts = pc.replace_substring_regex(texts, STOPS, r"\1 \2\3")
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        uniq = coded.dictionary.to_pylist()
        self._cache.ensure(uniq)
        ids = pa.array(map(self._cache.__getitem__, uniq), pa.large_binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], dtype=np.int64)[: len(ids) + 1]
        cuts = at[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in pairwise(cuts)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text of a list, as ``encode_array`` gives them."""
        return self.encode_array(pa.array(texts, pa.string()))


_ENCODERS: dict[str, PieceEncoder] = {}


def cut_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """Rows (uid, id, piece, start, length, ids_crc32, ids), one per piece; ``ids`` are unsigned integers as ``encode_array`` gives them.

    ``uid`` tells all rows apart, also those of repeated or null ids; it holds once the rows are written.
    """
    small_batches(docs.sparkSession, 3000)
    kind = docs.schema[id_col].dataType.simpleString()
    @lean("packing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = PieceEncoder(path)
        encoder = _ENCODERS[path]
        width, end = encoder.kind.itemsize, int(end_id).to_bytes(encoder.kind.itemsize, "little")
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 3000):
                part = batch.slice(at, 3000)
                names, rows, raws = part.column(0), [], []
                for i, raw in enumerate(encoder.encode_array(part.column(1))):
                    raw += end
                    n = len(raw) // width
                    for k, a in enumerate(range(0, n, capacity)):
                        b = min(a + capacity, n)
                        raws.append(raw[width * a : width * b])
                        whole = np.frombuffer(raws[-1], dtype=encoder.kind).astype("<u4", copy=False)
                        rows.append((uid + len(rows), i, k, a, b - a, zlib.crc32(whole)))
                table = np.array(rows, dtype=np.int64).reshape(-1, 6)
                uid += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(table[:, 0]),
                        names.take(pa.array(table[:, 1])),
                        pa.array(table[:, 2].astype(np.int32)),
                        *(pa.array(table[:, k]) for k in (3, 4, 5)),
                        pa.array(raws, pa.binary()),
                    ],
                    names=["uid", "id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"uid long, id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def knapsack(value: np.ndarray, size: np.ndarray, most: np.ndarray, room: int) -> dict[int, int]:
    """Item multiplicities of greatest value within ``room``, by dynamic programming over the room."""
    best = np.zeros(room + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for i in np.argsort(-value / size, kind="stable"):
        left, copies = min(int(most[i]), room // int(size[i])), 1
        while left:
            n = min(copies, left)
            s = n * int(size[i])
            better = best[:-s] + n * value[i] if s <= room else best[:0]
            hit = better > best[s:] + 1e-15
            if hit.any():
                best[s:] = np.where(hit, better, best[s:])
                taken.append((int(i), n, hit))
            left, copies = left - n, copies * 2
    out: dict[int, int] = defaultdict(int)
    at = int(best.argmax())
    for i, n, hit in reversed(taken):
        s = n * int(size[i])
        if at >= s and hit[at - s]:
            out[i] += n
            at -= s
    return dict(out)


@dataclass
class Group:
    """``count`` sequences of the same content: lengths with multiplicities, and the room left."""

    count: int
    content: dict[int, int]
    room: int


def solve(histogram: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT, rate: float = RATE, limit: int = CONFIGURATIONS) -> list[Group]:
    """Groups of sequences that hold exactly ``histogram`` (length -> count)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    groups: list[Group] = []
    full = left.pop(capacity, 0)
    if full:
        groups.append(Group(full, {capacity: 1}, 0))
    classes: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left, reverse=True):
        classes[-(-n // unit)].append(n)
    for count, config in configurations({k: sum(left[n] for n in v) for k, v in classes.items()}, capacity // unit, rate, limit):
        realise(groups, left, classes, count, config, capacity)
    groups = dissolve(groups, left, WASTE)
    best_fit(groups, left, capacity)
    return groups


def configurations(demand: dict[int, int], room: int, rate: float, limit: int) -> list[tuple[int, dict[int, int]]]:
    """Rounded-down amounts of configurations (class -> multiplicity) from the multiplicative weights."""
    if not demand:
        return []
    size = np.array(sorted(demand), dtype=np.int64)
    need = np.array([demand[int(s)] for s in size], dtype=np.float64)
    covered = np.zeros(len(size))
    amounts: dict[tuple, float] = defaultdict(float)
    for _ in range(limit):
        rest = np.maximum(1 - covered, 0)
        open_ = rest > 1e-9
        if not open_.any():
            break
        # a price per piece: its length, raised while its class is covered less than the others
        price = size * np.exp(rate * (rest - rest[open_].min())) * open_
        most = np.where(open_, np.ceil(need * rest), 0).astype(np.int64)
        config = knapsack(price[open_], size[open_], most[open_], room)
        if not config:
            break
        index = np.flatnonzero(open_)
        step = min(need[index[i]] * rest[index[i]] / m for i, m in config.items())
        step = min(step, max(min(need[index[i]] * rate / m for i, m in config.items()), 1.0))
        for i, m in config.items():
            covered[index[i]] += m * step / need[index[i]]
        amounts[tuple(sorted((int(size[index[i]]), m) for i, m in config.items()))] += step
    return [(int(x + 1e-6), dict(c)) for c, x in amounts.items() if x >= 1 - 1e-6]


def realise(groups: list[Group], left: dict[int, int], classes: dict[int, list[int]], count: int, config: dict[int, int], capacity: int) -> None:
    """Turn ``count`` sequences of a configuration of classes into groups of exact lengths."""
    while count > 0:
        content: dict[int, int] = defaultdict(int)
        for k, m in config.items():
            for n in classes[k]:
                take = min(m, left.get(n, 0) // count or min(left.get(n, 0), 1) * (count == 1))
                if take:
                    content[n] += take
                    m -= take
                if not m:
                    break
            if m:  # no length of the class lasts for all sequences: fill with the most plentiful one
                n = max(classes[k], key=lambda x: left.get(x, 0) - content.get(x, 0) * count)
                if left.get(n, 0) > content.get(n, 0):
                    content[n] += min(m, left[n] - content.get(n, 0))
        if not content:
            return
        now = min([count, *(left[n] // m for n, m in content.items())])
        if not now:
            return
        fill(content, left, now, capacity)
        for n, m in content.items():
            left[n] -= m * now
        groups.append(Group(now, dict(content), capacity - sum(n * m for n, m in content.items())))
        count -= now


def fill(content: dict[int, int], left: dict[int, int], count: int, capacity: int) -> None:
    """Exchange one piece of ``content`` for a longer one, so that the least room stays."""
    room = capacity - sum(n * m for n, m in content.items())
    best: tuple[int, int, int] | None = None
    for n in content:
        for more in range(room, 0, -1):
            if left.get(n + more, 0) >= (content.get(n + more, 0) + 1) * count:
                if best is None or more > best[0]:
                    best = (more, n, n + more)
                break
    if best:
        _, n, longer = best
        content[n] -= 1
        if not content[n]:
            del content[n]
        content[longer] = content.get(longer, 0) + 1


def dissolve(groups: list[Group], left: dict[int, int], room: int) -> list[Group]:
    """Keep the groups that leave at most ``room``; the others' pieces are to be placed again."""
    for x in groups:
        if x.room > room:
            for n, m in x.content.items():
                left[n] = left.get(n, 0) + m * x.count
    return [x for x in groups if x.room <= room]


def best_fit(groups: list[Group], left: dict[int, int], capacity: int) -> None:
    """Place what is left, longest first, where the least room stays; open sequences as needed."""
    by_room: dict[int, list[int]] = defaultdict(list)
    for g, x in enumerate(groups):
        by_room[x.room].append(g)
    rooms = sorted(by_room)
    for n in sorted(left, reverse=True):
        need = left[n]
        while need:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                fit = capacity // n
                whole, part = divmod(need, fit)
                fresh = [(whole, fit)] * (whole > 0) + [(1, part)] * (part > 0)
                for count, m in fresh:
                    _put(groups, by_room, rooms, Group(count, {n: m}, capacity - n * m))
                break
            room = rooms[at]
            g = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            x = groups[g]
            fit = room // n
            whole = min(x.count, need // fit)
            m = fit if whole else need
            whole = whole or 1
            rest = x.count - whole
            x.count = whole
            before = dict(x.content)
            x.content[n] = x.content.get(n, 0) + m
            x.room = room - n * m
            need -= whole * m
            _index(by_room, rooms, x.room, g)
            if rest:
                _put(groups, by_room, rooms, Group(rest, before, room))
        left[n] = 0


def _put(groups: list[Group], by_room: dict[int, list[int]], rooms: list[int], group: Group) -> None:
    groups.append(group)
    _index(by_room, rooms, group.room, len(groups) - 1)


def _index(by_room: dict[int, list[int]], rooms: list[int], room: int, g: int) -> None:
    if room not in by_room:
        bisect.insort(rooms, room)
    by_room[room].append(g)


class Placement:
    """For each length the ranks' ranges with their group's first sequence, multiplicity and offset."""

    def __init__(self, groups: list[Group]):
        ranges: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        first = 0
        for x in groups:
            offset = 0
            for n, m in sorted(x.content.items(), reverse=True):
                ranges[n].append((used[n], first, m, offset))
                used[n] += x.count * m
                offset += n * m
            first += x.count
        self.sequences = first
        self.ranges = {n: np.array(v, dtype=np.int64) for n, v in ranges.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given their lengths and their ranks within their length."""
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(length) else []
        for a, b in zip(cuts, [*cuts[1:], len(length)], strict=True):
            rows = order[a:b]
            n = int(length[rows[0]])
            table = self.ranges[n]
            hit = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
            start, first, m, off = table[hit].T
            k = rank[rows] - start
            sequence[rows], offset[rows] = first + k // m, off + k % m * n
        return sequence, offset


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds (part, nth): the range partition of a row and its place among the partition's rows of its length."""

    @lean("packing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            at = np.arange(len(length))
            fresh = np.r_[len(length) > 0 and length[0] != last, np.diff(length) != 0][: len(length)]
            start = np.maximum.accumulate(np.where(fresh, at, 0)) if len(length) else at
            nth = at - start
            if len(length):
                head = start == 0
                nth = nth + np.where(head & ~fresh[0], count, 0) if not fresh[0] else nth
                last, count = int(length[-1]), int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(length), part, dtype=np.int32)), pa.array(nth.astype(np.int64))],
                names=[*batch.schema.names, "part", "nth"],
            )

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["length", F.xxhash64("id", "piece", "ids_crc32").alias("_deal"), "id", "piece", "ids_crc32"]
    dealt = pieces.repartitionByRange(parts, "length", key[1], "id", "piece").sortWithinPartitions("length", key[1], "id", "piece", "ids_crc32")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(run, f"{fields}, part int, nth long")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, ids, sequence_id, offset), one per piece of every row of ``docs``.

    ``ids`` are the piece's token ids as little-endian unsigned integers, of two bytes for a vocabulary of at most
    65,536 ids and of four for others; a sequence is its pieces' ids by offset. ``ids_crc32`` is of ids of four bytes.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, path, id_col, text_col, capacity, end_id), "pieces")
    rows = materialize(ranked(pieces.drop("ids")), "ranked")
    # one row per partition and length: at most partitions + lengths rows, as the partitions are ranges
    counts = rows.groupBy("length", "part").count().toPandas().sort_values(["length", "part"])
    totals = counts.groupby("length")["count"].sum()
    placement = Placement(solve({int(n): int(c) for n, c in totals.items()}, capacity))
    before = counts.groupby("length")["count"].cumsum() - counts["count"]
    offsets = {(int(n), int(p)): int(b) for n, p, b in zip(counts["length"], counts["part"], before, strict=True)}
    shared = spark.sparkContext.broadcast((placement, offsets))
    fields = ["uid", "id", "piece", "start", "length", "ids_crc32"]

    @lean("packing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, base = shared.value
        for batch in batches:
            length, part, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "part", "nth"))
            rank = nth + np.fromiter((base[n, p] for n, p in zip(length.tolist(), part.tolist(), strict=True)), dtype=np.int64, count=len(nth))
            sequence, offset = plan.place(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in fields), pa.array(sequence), pa.array(offset)],
                names=[*fields, "sequence_id", "offset"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"uid long, id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    # hash tables of the places, which are few bytes a piece; the ids stream past them unsorted
    placed = rows.mapInArrow(run, schema).hint("shuffle_hash").join(pieces.select("uid", "ids"), "uid")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
