"""Classifier, language ID, token counts and quality rules against libraries, brute force and held-out labels."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfabric.llm import lang_id, quality_classifier, quality_rules, token_counts
from wayfabric.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"

TEXTS = st.text(alphabet=st.sampled_from(list("ab tT'sl\n\t 1é日\x1c ̈.,!<|>endofx")), max_size=60)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(vocabulary("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXTS, max_size=5))
def test_token_counts_match_the_library(library, counter, texts):
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "<|endoftext|>", "x<|endoftext|><|endoftext|>y", " \n \n x", "  two  spaces  ", "I'll don't 'S", "\r\n\r\n", "é" * 500])
def test_token_counts_of_hard_texts(library, counter, text):
    assert counter.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_token_count_rows(awkward, nothing, library):
    path = vocabulary("byte_bpe_50k.json")
    out = token_counts.count_tokens(awkward.withColumnRenamed("source", "n_tokens"), path)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    texts = [r["text"] or "" for r in awkward.collect()]
    want = Counter((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert Counter((r["n_bytes"], r["n_tokens"]) for r in out.collect()) == want
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_classifier_on_held_out_rows(spark):
    out = QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert len(held) > 40 and (held["predicted"] == held["quality"]).mean() > 0.95
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()


def test_classifier_defined_cases(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 1), (16, 0), (17, 0), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.learn(awkward, labels)
    out = quality_classifier.classify(awkward.withColumnRenamed("source", "score"), model).toPandas()
    assert len(out) == awkward.count() and out["score"].between(0, 1).all()
    blank = quality_classifier.learn(nothing, labels.limit(0))
    assert {r["score"] for r in quality_classifier.classify(awkward, blank).collect()} == {0.5}
    assert quality_classifier.classify(nothing, model).count() == 0


def test_classifier_learns_from_every_labelled_row(spark):
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 2, 25_000).tolist()
    docs = spark.createDataFrame([(i, "good plain words here" if k else "BAD # | WORDS") for i, k in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, quality int")
    mean = np.mean([quality_classifier.features("good plain words here" if k else "BAD # | WORDS") for k in kinds], axis=0)
    model = quality_classifier.learn(docs, labels)
    assert np.allclose(model.mid, mean, atol=1e-12)  # a mean over fewer rows differs
    assert quality_classifier.classify(docs, model).join(labels, "doc_id").where("predicted <> quality").count() == 0


def test_pairs_rank_the_preferred_higher():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ np.array([2.0, -1.0, 0.0]) + rng.normal(size=400) * 0.2 > 0).astype(int)
    w = quality_classifier.fit_bradley_terry(x, y)
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0]


def test_language_on_held_out_rows(spark):
    out = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert len(held) > 100 and (held["lang_pred"] == held["lang"]).mean() > 0.97


def test_language_defined_cases(awkward, nothing):
    model = lang_id.learn(awkward)
    rows = {r["doc_id"]: r for r in lang_id.identify(awkward.withColumnRenamed("source", "score"), model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (4, 5, 6, 14))
    assert rows[11]["lang_pred"] in model.langs and rows[1]["lang_pred"] == "en"
    blank = lang_id.learn(nothing)
    assert {r["lang_pred"] for r in lang_id.identify(awkward, blank).collect()} == {"und"}
    assert lang_id.identify(nothing, model).count() == 0
    kept = lang_id.keep_identified(awkward, model)
    assert kept.columns == awkward.columns and 4 not in {r["doc_id"] for r in kept.collect()}


@settings(max_examples=100, deadline=None)
@given(seed=st.integers(0, 10_000), penalty=st.floats(0, 6))
def test_viterbi_against_all_paths(seed, penalty):
    rng = np.random.default_rng(seed)
    seqs = [rng.normal(size=(rng.integers(1, 6), 3)) * 3 for _ in range(3)]
    for s, path in zip(seqs, lang_id.viterbi(seqs, penalty), strict=True):

        def value(p, s=s):
            return sum(s[i, k] for i, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))

        best = max(value(p) for p in np.ndindex(*[3] * len(s)))
        assert value(path.tolist()) == pytest.approx(best)


def test_single_language_shortcut_equals_viterbi():
    rng = np.random.default_rng(1)
    words = [f"w{'abcdefgh'[i]}" for i in range(8)]
    model = lang_id.LanguageModel(["x", "y"], rng.integers(0, 50, (2, lang_id.BUCKETS + len(lang_id.SCRIPTS))).astype(float))
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(60)]
    index, scores = model.table(texts)
    for ix, path in zip(index, model.label(texts, 3.0), strict=True):
        assert path.tolist() == lang_id.viterbi([scores[ix]], 3.0)[0].tolist()


def test_mixed_text_gets_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.learn(docs)
    spans = model.spans("the that and with are is of from this have " * 3 + "der und die das ist ein nicht auf einer auch " * 3)
    assert [s[0] for s in spans] == ["en", "de"]


def naive_rules(text):
    t = text or ""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("ab \n\t|#\x1c\x85 é")), max_size=60))
def test_base_counts(text):
    assert quality_rules.base_counts(text) == naive_rules(text)


def test_quality_rules_rows(spark, awkward, nothing):
    chain = quality_rules.learn(awkward)
    out = {(r["doc_id"], r["n_words"]): r for r in quality_rules.apply_rules(awkward.withColumnRenamed("source", "kept"), chain).collect()}
    for r in awkward.collect():
        n = naive_rules(r["text"])
        got = out[r["doc_id"], n[0]]
        assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert got["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (got["base_failed"] and got["kept"])
    assert quality_rules.apply_rules(nothing, quality_rules.learn(nothing)).count() == 0


def test_chain_learns_from_every_line(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_rules.LineChain, "fit", lambda self, tables: seen.extend(len(y) for _, y in tables) or self)
    lines = "\n".join(f"line {k} of a long text." for k in range(450))
    quality_rules.learn(spark.createDataFrame([(1, lines), (2, "one line only")], "doc_id long, text string"))
    assert sorted(seen) == [1, 450]


def test_chain_of_mixed_lengths_separates_lines():
    rng = np.random.default_rng(7)
    tables = []
    for n in [1, 2, 3, 60, 500, *range(4, 30)]:
        labels = np.repeat(rng.integers(0, 2, size=-(-n // 5)), 5)[:n]
        rows = np.zeros((n, quality_rules.WIDTH))
        rows[:, 0], rows[:, 9] = 1, labels
        tables.append((rows, labels))
    chain = quality_rules.LineChain().fit(tables)
    for rows, labels in tables:
        assert (chain.decode(rows) == labels).all()


def test_neighbours_decide_a_verdict():
    """A faint line between boilerplate lines: content by itself, boilerplate to the chain; the verdict turns on it."""
    chain = quality_rules.LineChain()
    chain.w[0] = [0.1, 0.0]  # every line leans to content,
    chain.w[2] = [0.0, 5.0]  # lines of marked words do not
    chain.t[:] = [[1.0, -1.0], [-1.0, 1.0]]
    text = "buy! now!\nplain words stand here for a line of some length\nbuy! more!\nbuy! all!"
    rows, sizes = quality_rules.line_table(quality_rules.split_lines(text))
    alone = (rows @ chain.w).argmax(axis=1)
    assert sizes[alone == 0].sum() / sizes.sum() >= quality_rules.KEEP_SHARE > chain.content_share(text)
    paths = list(np.ndindex(*[2] * len(rows)))
    e = rows @ chain.w
    best = max(paths, key=lambda p: sum(e[i, k] for i, k in enumerate(p)) + sum(chain.t[a, b] for a, b in zip(p, p[1:], strict=False)))
    assert chain.decode(rows).tolist() == list(best)


def test_verdicts_by_brute_force(spark):
    """Every verdict of a small table against the best of all label sequences, scored one by one."""
    rng = np.random.default_rng(11)
    lines = ["all rights reserved by the owner", "a plain line of words that says something.", "#### $$$$ ||||", "BUY NOW AND SAVE!", "more words follow, and then they end."]
    texts = ["\n".join(f"{lines[k]} {i}" for i, k in enumerate(rng.integers(0, 5, rng.integers(1, 8)))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("key", F.lit("k")).withColumn("y", F.lit(2))
    chain = quality_rules.learn(df)
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(df, chain).collect()}
    for i, text in enumerate(texts):
        rows, sizes = quality_rules.line_table(quality_rules.split_lines(text))
        e = rows @ chain.w
        best = max(np.ndindex(*[2] * len(rows)), key=lambda p: sum(e[j, k] for j, k in enumerate(p)) + sum(chain.t[a, b] for a, b in zip(p, p[1:], strict=False)))
        share = sizes[np.array(best) == 0].sum() / sizes.sum()
        assert got[i]["content_share"] == pytest.approx(0.0 if got[i]["base_failed"] else share)
        assert got[i]["kept"] == (not got[i]["base_failed"] and share >= quality_rules.KEEP_SHARE)


def test_long_text_of_many_lines():
    text = "\n".join(f"line {k} has words" for k in range(200_000))
    chain = quality_rules.LineChain()
    chain.w[0] = [1.0, 0.0]
    assert chain.content_share(text) == 1.0


def test_line_chain_decodes_best_path():
    rng = np.random.default_rng(3)
    chain = quality_rules.LineChain()
    chain.w, chain.t = rng.normal(size=(quality_rules.WIDTH, 2)), rng.normal(size=(2, 2))
    for _ in range(20):
        rows = rng.normal(size=(rng.integers(1, 7), quality_rules.WIDTH))
        e = rows @ chain.w

        def value(p, e=e):
            return sum(e[i, k] for i, k in enumerate(p)) + sum(chain.t[a, b] for a, b in zip(p, p[1:], strict=False))

        best = max(value(p) for p in np.ndindex(*[2] * len(rows)))
        assert value(chain.decode(rows).tolist()) == pytest.approx(best)


def test_clean_documents_are_kept(spark):
    rows = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    open_ = rows[~rows["base_failed"]]
    assert open_[open_["quality"] == 1]["kept"].mean() > 0.98 and open_[open_["quality"] == 0]["kept"].mean() < 0.1


def test_queries_have_their_columns(spark):
    want = {
        "op1_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
        "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op3_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    }
    for name, cols in want.items():
        df = QUERIES[name](spark, SF)
        assert df.columns == cols and df.count() == 200
    assert pa.__version__
