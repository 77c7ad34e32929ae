"""Embedding, substring and n-gram joins, mixing, packing, chat trees and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfabric.llm import chat_format, embedding_dedup, ngram_join, packing, source_mixing, substring_dedup
from wayfabric.llm.queries import ORACLES, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


def roots(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


# ---- embeddings -----------------------------------------------------------------------------


def brute_links(rows, threshold=0.93):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], dtype=float) / np.linalg.norm(np.array(rows[i][1], dtype=float)) for i in ok}
    return [(i, j) for a, i in enumerate(ok) for j in ok[a + 1 :] if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]


def vectors(seed, n=150, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = [(k, (centres[k % 6] + rng.normal(size=width) * 0.22).astype(np.float32).tolist(), k % 2) for k in range(n)]
    rows += [(n + k, rows[k][1], rows[k][2]) for k in range(5)] + [rows[0]]
    odd = [None, [], [0.0] * width, [float("nan")] * width, [float("inf")] + [1.0] * (width - 1), [None] * width]
    rows += [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(2000, rows[0][1], None), (2001, rows[0][1][:8], 0)]
    return rows


@pytest.mark.parametrize("block", [1500, 20])
def test_embedding_links(spark, block):
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = embedding_dedup.near_duplicates(df.withColumn("n_links", F.lit("x")), tables=8, probes=4, block=block).collect()
    links = brute_links(rows)
    want_n = Counter(x for pair in links for x in pair)
    comp = roots(len(rows), links)
    names = defaultdict(list)
    for i, c in enumerate(comp):
        names[c].append(rows[i][0])
    want = Counter((rows[i][0], want_n[i], min(names[c])) for i, c in enumerate(comp))
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out)
    assert got == want and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_embedding_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    out = embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [2.0, 0.0], 1)], schema)).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in out} == {(None, 1, 5), (5, 1, 5)}


def test_vectors_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (5, [1.0, 0.1, 0.0, 0.0], 0), (6, [0.0, 0.0, 1.0, 0.1], 0), (6, [0.0, 0.1, 1.0, 0.1], 0)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == Counter([(1, 1, 1), (5, 1, 1), (1, 2, 1), (6, 2, 1), (6, 2, 1)])


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = embedding_dedup.hadamard(x)
    assert np.allclose((y**2).sum(1), (x**2).sum(1)) and np.allclose(embedding_dedup.hadamard(y), x)


def test_deeper_codes_find_near_vectors():
    rng = np.random.default_rng(2)
    x = embedding_dedup.unit_rows(rng.normal(size=(400, 64)))
    y = embedding_dedup.unit_rows(x + rng.normal(size=x.shape) * 0.045)
    assert ((x * y).sum(1) > 0.9).all()
    for depth in (1, 2):
        a, b = embedding_dedup.codes(x, depth), embedding_dedup.codes(y, depth)
        met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))
        assert met.mean() > 0.95


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_depth_loses_no_links(depth):
    rng = np.random.default_rng(3)
    x = embedding_dedup.unit_rows(rng.normal(size=(5000, 64)))
    side = rng.normal(size=x.shape)
    side = embedding_dedup.unit_rows(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * side

    def recall(depth):
        tables, probes = embedding_dedup.effort(depth)
        a, b = (embedding_dedup.codes(v, depth, tables, probes) for v in (x, y))
        return (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean()

    assert recall(depth) >= recall(1) - 0.0005


def test_depth_is_of_the_own_label(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=4).tolist(), "hot") for k in range(600)] + [(600 + k, rng.normal(size=4).tolist(), "small") for k in range(20)]
    df = spark.createDataFrame([(i, v, lab) for i, v, lab in rows], "cid long, vec array<double>, label string")
    got = {(r["label"], r["depth"]) for r in embedding_dedup.with_depth(df).collect()}
    assert got == {("hot", 2), ("small", 1)}
    out = embedding_dedup.near_duplicates(df, id_col="cid", vec_col="vec").collect()
    want = Counter(rows[x][0] for pair in brute_links(rows) for x in pair)
    assert {r["cid"]: r["n_links"] for r in out} == {i: want[i] for i, _, _ in rows}


# ---- substrings -----------------------------------------------------------------------------


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings_of_awkward_rows(spark, awkward, awkward_rows, nothing):
    want = Counter((r[0], *x) for r, x in zip(awkward_rows, brute_removed([r[1] for r in awkward_rows], 200), strict=True))
    got = substring_dedup.remove_repeats(awkward.withColumn("n_bytes", F.lit(1))).collect()
    assert Counter(tuple(r) for r in got) == want
    assert substring_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("split", [2000, 3])
def test_substrings_of_patchworks(spark, split):
    rng = random.Random(split)
    parts = ["".join(rng.choice("abcd é\0") for _ in range(rng.randrange(20, 400))) for _ in range(12)]
    texts = ["".join(rng.choice(parts)[rng.randrange(30) :] for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    hot = "".join(rng.choice("xyz") for _ in range(190))
    texts += ["".join(rng.choice("pqrs") for _ in range(30)) + hot + "".join(rng.choice("pq") for _ in range(40)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(df, split=split).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_removed(texts, 200))]


def test_substrings_of_one_crowded_passage(spark, monkeypatch):
    """Over SPLIT different spans around one anchor: at the default sizes only the merge can see some repeats."""
    rng = random.Random(8)
    hot = "".join(rng.choice("xyz") for _ in range(192))
    texts = ["".join(rng.choice("pqrs") for _ in range(24)) + hot + "".join(rng.choice("pqrs") for _ in range(24)) for _ in range(4500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = [(i, *x) for i, x in enumerate(brute_removed(texts, 200))]
    assert sorted(tuple(r) for r in substring_dedup.remove_repeats(df).collect()) == want
    monkeypatch.setattr(substring_dedup, "_across", lambda *a: None)
    alone = sorted(tuple(r) for r in substring_dedup.remove_repeats(df).collect())
    assert sum(r[2] for r in alone) < sum(r[2] for r in want)


def test_repeats_across_shards():
    rng = random.Random(3)
    for _ in range(60):
        length = rng.choice([1, 2, 4])
        shards, known = [], []
        for _ in range(rng.randint(1, 6)):
            parts, seen = [], set()
            for _ in range(rng.randint(1, 4)):
                part = bytes(rng.choice(b"ab\0\1") for _ in range(rng.randint(length, length + 3)))
                fresh = [part[i : i + length] for i in range(len(part) - length + 1)]
                if len({*fresh} - seen) == len(fresh):
                    seen |= {*fresh}
                    parts.append(part)
            if not parts:
                continue
            shards.append(parts)
            known.append([p[i : i + length] for p in parts for i in range(len(p) - length + 1)])
        times = Counter(w for x in known for w in x)
        for x, found in zip(known, substring_dedup.repeats_across(shards, length), strict=True):
            assert found.tolist() == [times[w] > 1 for w in x]


def test_suffix_classes_are_equal_windows():
    rng = random.Random(0)
    for _ in range(80):
        spans = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 10))]
        length = rng.choice([1, 3, 5, 20])
        owner, offset, label = substring_dedup.repeats_in_shard(spans, length)
        names: dict = {}
        for a, b, x in zip(owner, offset, label.tolist(), strict=True):
            assert names.setdefault(spans[a][b : b + length], x) == x
        assert len(set(names.values())) == len(names)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(40):
        text = bytes(rng.choice(b"aab") for _ in range(rng.randint(1, 80)))
        symbols = np.frombuffer(text, np.uint8).astype(np.int16) + 1
        order = substring_dedup.suffix_array(symbols)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common = substring_dedup.kasai(symbols, order, np.array([0]), np.array([len(text)]), 200)
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert common[b] == k


def test_cut_texts_keep_columns(awkward, awkward_rows):
    out = substring_dedup.cut_texts(awkward)
    assert out.columns == awkward.columns and out.count() == len(awkward_rows)
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by[4] is None and by[1] == "" and by[7] == "word"
    odd = {"_did": "doc_id", "_T1": "doc_id", "_ranges": "lang", "_whole": "source", "did": "lang", "span": "source", "copies": "n_chars"}
    more = substring_dedup.cut_texts(awkward.select("*", *[F.col(c).alias(name) for name, c in odd.items()]))
    assert more.columns == [*awkward.columns, *odd]
    key = str
    assert sorted(map(tuple, more.select(*awkward.columns).collect()), key=key) == sorted(map(tuple, out.collect()), key=key)
    assert all(r[name] == r[c] for r in more.collect() for name, c in odd.items())


# ---- n-gram join ----------------------------------------------------------------------------


def brute_sets(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def brute_components(rows, width, percent):
    sets = brute_sets([r[1] for r in rows], width)
    links = []
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * len(sets[i] | sets[j]):
                links.append((j, i))
    comp = roots(len(rows), links)
    ids = defaultdict(list)
    for i, c in enumerate(comp):
        ids[c].append(rows[i][0])
    return [(r[0], len(s), min((x for x in ids[c] if x is not None), default=None)) for r, s, c in zip(rows, sets, comp, strict=True)]


def near_copies(seed, n=90):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocab) for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words), "en", "s", 0))
    return rows


def test_ngram_survivors_are_asked_again(spark, tmp_path, monkeypatch):
    """Classes that met only classes that are done with are done with too; linked ones stay."""
    monkeypatch.setattr(ngram_join, "AGAIN", 0)
    rows = [(k, 20, [100 * k + i for i in range(2)] + [100 * (k + 1), 100 * (k + 1) + 1] + [9000 + k]) for k in range(1, 12)]
    rows = [(0, 20, [100, 7000]), *rows, (20, 20, [1, 2, 3]), (21, 20, [1, 2, 4])]  # 0 shares one n-gram only, 20 and 21 two
    spark.createDataFrame(rows, "cid long, n long, prefix array<long>").repartition(1).write.parquet(str(tmp_path / "listed"))
    monkeypatch.setattr(ngram_join, "_postings", lambda c: c.selectExpr("explode(prefix) as g", "n", "cid").coalesce(1).sortWithinPartitions("g", "n", "cid"))
    passes, ask = [], ngram_join._survivors
    monkeypatch.setattr(ngram_join, "_survivors", lambda c, p: passes.append(1) or ask(c, p))
    left = {r["cid"] for r in ngram_join._linkable(spark, str(tmp_path / "listed"), 85).collect()}
    assert {20, 21} <= left
    assert len(passes) > 1


@pytest.mark.parametrize(("block", "frequent"), [(1200, 1000), (6, 0)])
def test_ngram_components(spark, block, frequent):
    rows = near_copies(block)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = ngram_join.join_components(df, 3, 80, block=block, frequent=frequent).collect()
    assert sorted((r["did"], r["n_shingles"], r["component_id"]) for r in out) == sorted(brute_components(rows, 3, 80))


def passage_chain(n, every):
    """Texts that each share a passage with the next, so that they chain without links, and near copies of some."""
    word = lambda *x: "w" + "_".join(map(str, x))
    texts = [[*(word(i, k) for k in range(30)), *(word("own", i, k) for k in range(40)), *(word(i + 1, k) for k in range(30))] for i in range(n)]
    texts += [[*t[:50], "changed", *t[51:]] for t in texts[::every]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_chained_texts_that_do_not_link_are_not_multiplied(spark, monkeypatch):
    """A large block of them ships fewer sets than there are classes, instead of every set to every tile."""
    rows, shipped, solve = passage_chain(60, 10), [], ngram_join._block_edges

    def counted(sets, percent, keys, two_sided=False):
        shipped.append(sets.count() if two_sided else 0)
        return solve(sets, percent, keys, two_sided)

    monkeypatch.setattr(ngram_join, "_block_edges", counted)
    out = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, block=4, frequent=0).collect()
    assert sorted((r["did"], r["n_shingles"], r["component_id"]) for r in out) == sorted(brute_components(rows, 4, 85))
    assert sum(shipped) <= len(rows)


def test_ngram_awkward_rows(awkward, awkward_rows, nothing):
    out = ngram_join.join_components(awkward.withColumn("n", F.lit(1)), 4, 85).collect()
    want = Counter(brute_components(awkward_rows, 4, 85))
    assert Counter((r["did"], r["n_shingles"], r["component_id"]) for r in out) == want
    assert ngram_join.join_components(nothing, 4, 85).count() == 0


def test_one_per_group_stays(awkward, awkward_rows):
    out = ngram_join.keep_one_per_group(awkward, 5, 80)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == awkward.columns and ids.count(16) == 1 and 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and 8 not in ids


def test_texts_that_share_an_id(spark):
    rng = random.Random(7)
    a, b = ([f"{c}{rng.randrange(1000)}" for _ in range(80)] for c in "ab")
    near = lambda words, x: " ".join([*words[:40], x, *words[41:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, near(a, "x")), (6, near(b, "y")), (None, near(a, "z")), (None, near(b, "z")), (None, "alone in the table without any other"), (7, "alone " * 30), (7, "alone " * 30)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, did int")
    out = ngram_join.join_components(df, 5, 80).collect()
    assert Counter((r["did"], r["n_shingles"], r["component_id"]) for r in out) == Counter(brute_components(rows, 5, 80))
    named = {"_text": "text", "row": "did", "T1": "doc_id", "copies": "text", "_did": "did"}
    kept = ngram_join.keep_one_per_group(df.select("*", *[F.col(c).alias(x) for x, c in named.items()]), 5, 80)
    assert kept.columns == [*df.columns, *named]
    left = kept.collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == sorted((i or 0, t) for i, t in [rows[0], rows[1], rows[6], rows[7]])
    assert all(r[x] == r[c] for r in left for x, c in named.items())


def test_block_links_match_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(30)]
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    i, j = ngram_join.block_links(sets, 60)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    i, j = ngram_join.block_links(sets, 60, left=12)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {p for p in want if p[0] < 12 <= p[1]}


# ---- mixing ---------------------------------------------------------------------------------


def test_mixing_oracle(spark, duck, same_rows):
    same_rows(QUERIES["op6_source_mixing"](spark, SF), duck, ORACLES["op6_source_mixing"])


def brute_budget(tree, budget, cap):
    """Round by round: what full children leave over goes to their siblings."""
    open_, given = dict(tree), {}
    while open_:
        share = {k: budget * w / sum(w for w, _ in open_.values()) for k, (w, _) in open_.items()}
        full = {k for k, (w, c) in open_.items() if c <= share[k]}
        if not full:
            given |= share
            break
        for k in full:
            given[k] = open_.pop(k)[1]
            budget -= given[k]
    return given


def test_budgets_match_rounds_of_redistribution(spark):
    rng = random.Random(8)
    for _ in range(2):
        leaves = [(f"d{i}", f"s{j}", rng.randrange(1, 400)) for i in range(3) for j in range(3)]
        weights = {"d": {f"d{i}": rng.randrange(1, 5) for i in range(3)}, "s": {f"s{j}": rng.randrange(1, 5) for j in range(3)}}
        total = sum(x[2] for x in leaves)
        df = spark.createDataFrame(leaves, "d string, s string, tokens long")
        out = source_mixing.allocate(df, ["d", "s"], weights, F.lit(int(total * 1.2)).cast("long"), 2)
        got = {(r["d"], r["s"]): r["given"] for r in out.collect()}
        caps = {d: sum(2 * t for a, _, t in leaves if a == d) for d in weights["d"]}
        top = brute_budget({d: (weights["d"][d], caps[d]) for d in caps}, int(total * 1.2), None)
        for d, b in top.items():
            for s, x in brute_budget({s: (weights["s"][s], 2 * t) for a, s, t in leaves if a == d}, b, None).items():
                assert abs(got[d, s] - x) <= 4


def test_mixing_awkward_rows(awkward, nothing):
    levels = {"domain": source_mixing.source_domain(), "lang": F.col("lang"), "source": F.col("source")}
    out = source_mixing.mix(awkward, levels, budget=1.0, max_epochs=2)
    assert out.columns == [*awkward.columns, "n_tokens", "epoch"]
    names = ["_rest", "_order", "row", "id", "n", "level_0", "last", "bucket", "Epoch"]
    more = source_mixing.mix(awkward.select("*", *[F.col("lang").alias(x) for x in names]), levels, budget=1.0, max_epochs=2)
    assert more.columns == [*awkward.columns, *names, "n_tokens", "epoch_"]
    assert sorted(map(str, more.drop("Epoch").withColumnRenamed("epoch_", "epoch").select(*out.columns).collect())) == sorted(map(str, out.collect()))
    tokens = out.agg(F.sum("n_tokens")).first()[0]
    own = awkward.select(source_mixing.words_between_spaces(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert 0 < tokens <= own
    everything = source_mixing.mix(awkward, levels, budget=5.0, max_epochs=3)
    busy = awkward.where("length(text) > 0").count()
    assert everything.where("n_tokens > 0").count() == 3 * busy
    assert source_mixing.mix(nothing, levels).count() == 0
    assert source_mixing.mix(awkward, levels, budget=0.0).where("n_tokens > 0").count() == 0


# ---- packing --------------------------------------------------------------------------------


def test_packing_rows(spark, awkward, awkward_rows, nothing):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = packing.pack(awkward.withColumn("piece", F.lit(7)), path).toPandas()
    want = Counter()
    for r in awkward_rows:
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            want[r[0] if r[0] is not None else -1, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    cols = [out[c].fillna(-1).astype("int64") for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    assert Counter(zip(*cols, strict=True)) == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.r_[0, np.cumsum(g["length"])[:-1]]).all() and g["length"].sum() <= 4096
    assert packing.pack(nothing, path).count() == 0


def test_packing_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), packing.PieceEncoder(path)
    rng = random.Random(12)
    marks = ["\u0331", "\u030c", "\u0308", "\u030a", "\u0323", "\u0301"]
    bits = [*"HJTWYaeiost", *marks, *".,;:!?'\"-5", " ", " ", "\n", "\t", "\x1c", "\x85", "\u3000", "é", "日", "'s", "'ll", "it's.", "end.", "<|endoftext|>", "<|", "|>", "\u1100\u1161", "²"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += [f"{c}{m}" for c in "HJTWYA" for m in marks] + ["a.", "a .", "a..,b", "'.", "don't, 'tis.\n", "5. 5.5, 5", ""]
    for some in (texts, [t for t in texts if "<|" not in t]):
        got = [np.frombuffer(x, dtype=mine.kind).tolist() for x in mine.encode(some)]
        want = [library.encode(t, add_special_tokens=False).ids for t in some]
        assert [(t, g, w) for t, g, w in zip(some, got, want, strict=True) if g != w] == []


def test_packing_stops_after_letters_that_end_in_a_mark():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), packing.PieceEncoder(path)
    letters = [chr(c) for c in (0x130, 0xE9, 0x3A9, 0x958, 0x9DC, 0xA33, 0xB5C, 0xF43, 0xFB2A, 0xFB4E, 0x1D15E, 0x1E900, 0x10D4A, 0x41)]
    texts = [f.replace("{}", c) for c in letters for f in ("{}.", "a{}, B", "x {}!?\n", "{}:\t{}")]
    got = [np.frombuffer(x, dtype=mine.kind).tolist() for x in mine.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_returns_the_sequences(spark, awkward, awkward_rows):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = packing.pack(awkward, path).toPandas().sort_values(["sequence_id", "offset"])
    read = Counter()
    for _, g in out.groupby("sequence_id"):
        sequence = np.frombuffer(b"".join(g["ids"]), dtype="<u2")
        assert len(sequence) == g["length"].sum()
        for i, k, at, n in zip(g["doc_id"].fillna(-1).astype("int64"), g["piece"], g["offset"], g["length"], strict=True):
            read[i, k, tuple(sequence[at : at + n].tolist())] += 1
    want = Counter()
    for r in awkward_rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[r[0] if r[0] is not None else -1, k // 4096, tuple(ids[k : k + 4096])] += 1
    assert read == want


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_close_to_the_bound(seed):
    rng = random.Random(seed)
    hist = Counter(min(4096, max(1, int(rng.lognormvariate(6, 0.9)))) for _ in range(3000))
    groups = packing.solve(hist)
    held = Counter()
    for g in groups:
        assert sum(n * m for n, m in g.content.items()) + g.room == 4096 and g.room >= 0 and g.count > 0
        for n, m in g.content.items():
            held[n] += m * g.count
    assert held == hist
    bound = -(-sum(n * c for n, c in hist.items()) // 4096)
    assert sum(g.count for g in groups) <= bound * 1.01 + 1


def test_packing_of_awkward_lengths():
    for hist in ({2049: 5}, {4096: 3}, {1: 10_000}, {1366: 7, 1365: 2}, {3000: 4, 1096: 4}, {}):
        groups = packing.solve(hist)
        assert sum(g.count * n * m for g in groups for n, m in g.content.items()) == sum(n * c for n, c in hist.items())
    assert sum(g.count for g in packing.solve({3000: 4, 1096: 4})) == 4


def test_knapsack_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        size, value, most = rng.integers(1, 9, 4), rng.random(4) + 0.1, rng.integers(1, 4, 4)
        room = int(rng.integers(3, 20))
        best = max(float(np.dot(c, value)) for c in np.ndindex(*(most + 1)) if np.dot(c, size) <= room)
        found = packing.knapsack(value, size, most, room)
        assert sum(size[i] * m for i, m in found.items()) <= room
        assert sum(value[i] * m for i, m in found.items()) == pytest.approx(best)


# ---- chat trees -----------------------------------------------------------------------------


def test_chat_oracle(spark, duck, same_rows):
    same_rows(QUERIES["op10_chat_format"](spark, SF), duck, ORACLES["op10_chat_format"])


def test_chat_tree_paths_and_ranks(spark):
    rows = [
        (1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "good", 2.0), (1, 2, 0, "assistant", "bad <|end|> [x] %p", 1.0), (1, 3, 1, "user", "more", 0.0),
        (1, 4, 3, "assistant", None, None), (2, 9, 77, None, "orphan", 1.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (1, 4, 3, "assistant", "zz", 0.0),
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    below = spark.createDataFrame([(3, 7, 2, "user", "below a cycle", 0.0), (3, 8, None, "user", "beside it", 0.0), (4, 1, 1, "user", "itself", 0.0)], df.schema)
    beside = chat_format.format_trees(df.unionByName(below)).select("tree", "leaf").collect()
    assert {tuple(r) for r in beside} == {(1, 4), (1, 2), (2, 9), (3, 8)}
    out = chat_format.format_trees(df.where("tree <> 3").withColumn("leaf", F.lit(1)))
    got = {(r["tree"], r["leaf"]): r for r in out.collect()}
    assert set(got) == {(1, 4), (1, 2), (2, 9)}
    assert got[1, 4]["rank"] == 1 and got[1, 2]["rank"] == 2 and got[1, 4]["n_turns"] == 4
    back = out.select("tree", "leaf", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("mask")).alias("m")).collect()
    said = {(r["tree"], r["leaf"]): ([(x["role"], x["text"]) for x in r["t"]], r["m"]) for r in back}
    assert said[1, 2] == ([("user", "q"), ("assistant", "bad <|end|> [x] %p")], "bad <|end|> [x] %p")
    assert said[1, 4] == ([("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "")], "good")
    assert said[2, 9] == ([("", "orphan")], "")
    assert chat_format.format_trees(df.where("tree <> 3"), best=1).count() == 2
    assert chat_format.format_trees(df.limit(0)).count() == 0


def test_chat_ties_nulls_and_long_chains(spark):
    rows = [(5, 1, "user", "a"), (5, 1, "user", "a"), (5, None, "assistant", "first"), (None, 0, None, None)] + [(6, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(130)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_trees(chat_format.chain_replies(df)).select("tree", "n_turns", chat_format.read_back(F.col("formatted")).alias("t")).collect()
    got = {r["tree"]: [(x["role"], x["text"]) for x in r["t"]] for r in out}
    assert got[5] == [("assistant", "first"), ("user", "a"), ("user", "a")] and got[None] == [("", "")]
    assert got[6] == [(r, t) for _, _, r, t in rows[4:]]


# ---- pipeline -------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp

    from wayfabric.scratch import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    frames = {"documents": docs}
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        frames[name] = docs
        if name != "packed":
            assert docs.columns == frames["documents"].columns
    one = {r["doc_id"]: r["text"] for r in frames["language"].collect()}
    assert len(one) > 0.97 * len(given)
    rows = [(r["doc_id"], r["text"], "", "", 0) for r in frames["language"].collect()]
    heads = {c for _, n, c in brute_components(rows, 5, 80) if n} | {i for i, n, _ in brute_components(rows, 5, 80) if not n}
    two = {r["doc_id"]: r["text"] for r in frames["near_duplicates"].collect()}
    assert set(two) == heads
    order = sorted(two)
    kept = {}
    raw = {i: two[i].encode() for i in order}
    count = Counter(r[k : k + 200] for r in raw.values() for k in range(len(r) - 199))
    for i in order:
        gone = np.zeros(len(raw[i]), dtype=bool)
        for k in range(len(raw[i]) - 199):
            if count[raw[i][k : k + 200]] > 1:
                gone[k : k + 200] = True
        text = np.frombuffer(raw[i], np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if text.strip(" "):
            kept[i] = text
    three = {r["doc_id"]: r["text"] for r in frames["repeated_passages"].collect()}
    assert three == kept
    four = {r["doc_id"]: r["text"] for r in frames["mixture"].collect()}
    assert set(four) <= set(three) and len(four) > 0.5 * len(three)
    packed = frames["packed"].toPandas()
    assert set(packed["doc_id"]) == set(four) and packed.groupby("sequence_id")["length"].sum().max() <= 4096
