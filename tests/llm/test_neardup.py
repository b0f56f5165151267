"""Groups of shingle similarity against brute force over all pairs."""

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import neardup, simhash


def plain_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """The ids that stay, one of each component of pairs of similarity 0.8; ids are numbers and differ."""
    sets, label = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (5 * len(a & b) >= 4 * len(a | b)) and bool(a) == bool(b):
                label[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key)
    return sorted(least.values())


def texts():
    rng = np.random.default_rng(3)
    out = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(5, 300)))]
        out.append(" ".join(base))
        for edits in rng.integers(0, 1 + len(base) // 25, 5):
            copy = list(base)
            for k in rng.integers(0, len(copy), edits):
                copy[k] = f"edit{rng.integers(0, 10**6)}"
            out.append("\n".join(copy).upper())
    return [*out, None, "", " \t", "one", "ONE", "one two", "x" * 100_000, "é ß  \n ü", out[0]]


def test_stage_matches_brute_force_similarity(spark):
    rows = list(enumerate(texts(), 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == want
    of_bits = simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert len(want) < of_bits  # three of 64 bits leave edited copies


def test_links_that_no_centre_has(spark):
    # a chain: each text is similar to its neighbours only, so most pairs of a bucket aren't links
    w = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(w[8 * k : 8 * k + 100])) for k in range(30)]
    assert [r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == plain_kept(rows) == [0]


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "A b c d e f"), (1, "another text under the same id"), (None, "z z z y"), (None, "Z z z y"), (None, "a b c d e f"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    kept = sorted(((r.doc_id or 0, (r.text or "").lower()) for r in neardup.keep_one(docs).collect()))
    assert kept == [(0, "z z z y"), (1, "a b c d e f"), (1, "another text under the same id"), (3, "")]
    assert neardup.keep_one(docs.limit(0)).collect() == []


def test_a_hot_bucket_costs_its_members_times_its_strangers(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK_ROWS", 10)
    rows = [(7, i, 0) for i in range(1000)] + [(7, 5000, 1)] + [(8, i, 2) for i in range(50)] + [(9, 1, 0), (9, 2, 1)]
    members = spark.createDataFrame(rows, "key long, node long, part long")
    lists = neardup._dealt(members, "key", F.lit(1 / 10)).collect()
    # key 8 has one part, key 9 fits in a list; each chunk of key 7's copies meets the stranger once
    assert sum(len(r.m) for r in lists) <= 1000 + 100 + 2 and sorted(len(r.m) for r in lists)[0] == 2
    met = {frozenset((a.node, b.node)) for r in lists for a in r.m for b in r.m if a.part != b.part}
    assert met == {frozenset((i, 5000)) for i in range(1000)} | {frozenset((1, 2))}


def test_dealt_lists_hold_every_pair_of_different_parts(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), i, int(rng.integers(0, 1 + k))) for k in range(4) for i in range(60)]
    lists = neardup._dealt(spark.createDataFrame(rows, "key long, node long, part long"), "key", F.lit(1 / 7)).collect()
    met = {(frozenset((a.node, b.node))) for r in lists for a in r.m for b in r.m if a.part != b.part}
    want = {frozenset((a, b)) for k, a, x in rows for m, b, y in rows if k == m and x != y}
    assert want <= met
    assert all(len(r.m) < 60 for r in lists)


def test_scratch_tables_are_deleted(spark, tmp_path):
    import glob

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{shared}/*"))
    kept = neardup.keep_one(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string"))
    kept.count()
    assert len(set(glob.glob(f"{shared}/*")) - before) == 1
