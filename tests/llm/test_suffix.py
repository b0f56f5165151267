"""Removed bytes against a plain set of all strings of the length."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import suffix


def plain(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (key, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(r, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé ", k=rng.randint(1, 9))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passages = [prose(rng.randint(60, 150)) for _ in range(5)]
    base = prose(400)
    rows = []
    for i in range(n):
        t = prose(rng.randint(0, 200))
        if i % 3 == 0:
            p = rng.choice(passages)
            t += p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)] + prose(rng.randint(0, 50))
        if i % 4 == 1:
            w = base.split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        rows.append((i, t))
    rows += [(900, None), (901, ""), (902, "a" * 2000), (903, "ab" * 399), (904, "x" * 399), (905, passages[0] * 2), (906, rows[0][1]), (906, rows[0][1]), (None, rows[2][1])]
    return rows


@pytest.mark.parametrize("many", [8000, 3])
def test_removed_bytes_match_brute_force(spark, many):
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k1", "2 AS low")
    got = suffix.drop_repeats(df, core_contexts=many).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, 400)


def test_periodic_texts_match_brute_force(spark):
    """Runs of one repeated word, of many periods, at the starts and in the middle of documents."""
    rng = random.Random(11)
    rows = []
    for i in range(120):
        unit = "".join(rng.choices("abcdefgé ", k=rng.choice([1, 2, 3, 7, 16, 17, 40, 144, 145, 146, 255, 256, 257, 300])))
        lead = "".join(rng.choices("xyz ", k=rng.choice([0, 0, 1, 20, 300])))
        rows.append((i, lead + unit * rng.randint(1, 1500 // len(unit) + 1) + "".join(rng.choices("uvw", k=rng.choice([0, 5, 200])))))
    rows += [(200 + i, "word " * k) for i, k in enumerate((79, 80, 81, 130, 900))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.drop_repeats(df).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, 400)


def test_empty_table(spark):
    assert suffix.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.binary(max_size=8), st.binary(max_size=14)), min_size=1, max_size=8), st.integers(2, 10))
def test_runs_of_both_arrays(contexts, length):
    few = lambda b: bytes(c % 3 for c in b)
    rows = list({(g, few(x), few(y)) for g, x, y in contexts})
    got = suffix.repeated_places(np.array([g for g, _, _ in rows]), [x + y for _, x, y in rows], np.array([len(x) for _, x, _ in rows]), length)
    for i, (g, x, y) in enumerate(rows):
        for o in range(got.shape[1]):
            whole = lambda x, y: (x[len(x) - o :] + y[: length - o]) if o <= length and len(x) >= o and len(y) >= length - o else None
            own = whole(x, y)
            if o <= length:
                assert got[i, o] == (own is not None and any(j != i and h == g and whole(p, q) == own for j, (h, p, q) in enumerate(rows)))
