"""Leaks against the plain edit-distance table over all stretches."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import decontam


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=90), st.lists(st.integers(0, 4), max_size=60))
def test_bit_vectors_give_the_table(pattern, text):
    got, _ = decontam.edit_distance_within(decontam.places(np.array(pattern)), len(pattern), np.array(text, int), 10**9)
    assert got == plain_distance(pattern, text)


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "and"] + [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 80)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "..."), (103, items[0][1]), (104, "lone")]
    docs = []
    for k in range(120):
        body = rng.choices(vocabulary, k=rng.randint(0, 200))
        if k % 2:
            _, text = items[rng.randrange(30)]
            leak = text.split()
            for _ in range(rng.randint(0, max(0, len(leak) // 8))):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = leak
        docs.append((k, " ".join(body).upper() if k % 5 == 0 else ",\n".join(body)))
    docs += [(500, None), (501, ""), (502, "Lone."), (503, items[1][1]), (503, items[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS edits")
    got = decontam.leaks(d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id")).collect()
    norm = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    true, exact = {}, set()
    for key, text in docs:
        for item, own in items:
            if w := norm(own):
                edits = plain_distance(w, norm(text))
                if edits <= int(0.2 * len(w) + 1e-9):
                    true[key, item] = edits
                    if edits == 0:
                        exact.add((key, item))
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    assert set(found) <= set(true)
    assert exact <= set(found)
    assert len(found) >= 0.95 * len(true)
    assert all(found[x] == 0 for x in exact)
    assert sum(r.doc_id == 503 and r.item_id == 1 for r in got) == 2


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(some, none).collect() == []
    assert decontam.leaks(some.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_items_without_an_id_are_searched(spark):
    one, two = "some passage of the benchmark without any id", "another and longer passage of it that has no id of its own either"
    items = spark.createDataFrame([(None, one), (None, two), (7, "an item with an id of its own")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {one} after"), (2, f"{two} after"), (3, "clean"), (4, "an item with an id of its own")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id or 0, r.similarity) for r in decontam.leaks(docs, items).collect()) == [(1, 0, 1.0), (2, 0, 1.0), (4, 7, 1.0)]
    assert [r.doc_id for r in decontam.keep_clean(docs, items).collect()] == [3]


def test_a_key_with_the_name_of_a_result_is_refused(spark):
    import pytest

    docs = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    with pytest.raises(ValueError):
        decontam.leaks(docs, docs, key="item_id")


def test_extra_columns_with_clashing_names_are_carried(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, item, "x", 5), (2, "clean text", "y", 6)], "doc_id long, text string, item_id string, edits int")
    bench = spark.createDataFrame([(9, item, 1)], "item_id long, text string, edits int")
    assert [(r.doc_id, r.item_id, r.edits) for r in decontam.leaks(docs, bench).collect()] == [(1, 9, 0)]
    assert [tuple(r) for r in decontam.keep_clean(docs, bench).collect()] == [(2, "clean text", "y", 6)]
