"""Documents with every awkward case the operators must define."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "and", "tion", "inger", "onhash", "re", "ereat", "ble", "thh"]) + rng.choice(["", "s", "ed", "ly", "x"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Rows with nulls in every column, empty and long texts, ties, near and exact copies, and repeated rows."""
    rng = random.Random(4)
    base = sentence(rng, 120)
    words = base.split()
    near = " ".join(w if i != 60 else "changed" for i, w in enumerate(words))
    passage = sentence(rng, 60)
    rows = [
        (1, base, "en", "src1"), (2, base, "en", "src1"), (3, near, "en", "src2"), (4, None, "en", "src1"), (5, "", None, "src3"),
        (6, "   \n\t ", "de", None), (7, "word", "de", "src2"), (8, "WORD", "de", "src2"), (9, "a b c", None, None), (None, base + " tail", "en", "src4"),
        (None, "no id here at all but some words", None, None), (10, sentence(rng, 6000), "en", "src1"), (11, "été été über ñandú 日本語 \U0001f600", "fr", "src5"),
        (12, sentence(rng, 80) + "\n" + passage, "en", "src6"), (13, sentence(rng, 70) + "\n" + passage + "\n" + sentence(rng, 20), "en", "src7"),
        (14, "12 34 !! ??", "en", "src1"), (15, "<|endoftext|> </s>[INST] x%p", "en", "src1"), (16, "x y z " * 40, "es", "src0"), (16, "x y z " * 40, "es", "src0"),
        (17, "same line\n" * 12, "es", "src0"), (18, "\x1c\x1f odd\x85space　here", "en", "src8"),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
