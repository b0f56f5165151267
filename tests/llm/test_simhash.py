"""SimHash groups against brute force over all pairs."""

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import simhash
from ledgerline.llm.common import connected_components


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=3):
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                label[root(i)] = root(j)
    least = {}
    for i in range(len(ids)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(ids))]


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(40):
        base = list(rng.choice(vocabulary, int(rng.integers(40, 400))))
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 6))):
            base[int(rng.integers(0, len(base)))] = "edited"
            texts.append("\n".join(base).upper())
    texts += [None, "", " \t", "one", "ONE", "one two", "x" * 100_000, "é ß  \n ü", texts[0], texts[0], "a b c", "A\tB\x0cC"]
    rows = list(enumerate(texts, 5))
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i, _ in rows] == fps
    assert all(len(r.fingerprint) == 16 for r in got.values())
    assert [got[i].component_id for i, _ in rows] == plain_components([i for i, _ in rows], fps)


def test_small_chunks_lose_no_link(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 1 << 62))
    fps = sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 63, (150, 3))} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    distinct = spark.createDataFrame([(f, bytearray(simhash.pivot_rows(np.array([f], np.uint64)).tobytes())) for f in fps], "fp long, coords binary")
    for rows in (1024, 16):
        found = {r.node: r.component for r in connected_components(simhash.links(distinct, 3, rows)).collect()}
        assert [found.get(f, f) for f in fps] == plain_components(fps, fps)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, u string, v string, fp string")
    assert simhash.near_duplicates(empty).collect() == []
    again = spark.createDataFrame([(1, "a b c d", 9), (1, "a b c d", 9), (None, "a b c d", 9)], "doc_id long, text string, component_id int")
    assert [r.component_id for r in simhash.near_duplicates(again).collect()] == [1, 1, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=2, max_size=40), st.integers(0, 63), st.integers(0, 63))
def test_pivot_rows_never_discard_a_link(fps, a, b):
    fp = np.array([*fps, fps[0] ^ (1 << a), fps[1] ^ (1 << a) ^ (1 << b)], np.uint64)
    fp = np.unique(fp)
    i, j = simhash.near_pairs(fp, simhash.pivot_rows(fp), 3)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(x, y) for x in range(len(fp)) for y in range(x + 1, len(fp)) if bin(int(fp[x] ^ fp[y])).count("1") <= 3}
