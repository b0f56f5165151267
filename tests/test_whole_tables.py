"""Queries that take every row and the whole of it, against plain versions."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.operators import joins, series
from ledgerline.plans import registry

SF = "/root/testdata/sf0.001"


def test_places_over_the_whole_table(spark):
    rng = np.random.default_rng(5)
    rows = [(int(r), int(k)) for r, k in zip(rng.integers(0, 3, 500), rng.permutation(5000)[:500] - 2500, strict=True)]
    got = series.placed(spark.createDataFrame(rows, "rank long, number long"), "rank", "number", width=64).collect()
    assert [(r.rank, r.number) for r in sorted(got, key=lambda r: r.place)] == sorted(rows)
    assert sorted(r.place for r in got) == list(range(1, 501))
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert registry.QUERIES["stable_priority_order"](spark, SF).count() == n


def test_assignment_of_unequal_sides(spark):
    rng = np.random.default_rng(6)
    for n, m in ((2, 6), (6, 2), (4, 4), (1, 5)):
        score = rng.integers(1, 50, (n, m))
        rows = [(0, a, b, float(score[a, b])) for a in range(n) for b in range(m)]
        got = joins.assigned(spark.createDataFrame(rows, "g int, left int, right int, score double"), "g").collect()
        s = score if n <= m else score.T
        most = max(sum(s[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(s.shape[1]), s.shape[0]))
        assert sum(r.score for r in got) == most and len(got) == min(n, m)
        assert len({r.left for r in got}) == len({r.right for r in got}) == len(got)


def test_assignment_takes_every_customer(spark, tmp_path):
    # customers of any key are matched, each within its own orders
    rows = [(key, 10 * key + k, status, price) for key in (1, 151, 10**9) for k, status, price in ((1, "O", 10.0), (2, "F", 10.0), (3, "F", 5000.0), (4, "P", 10.0))]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted((r.left, r.right) for r in registry.QUERIES["assignment_matching"](spark, str(tmp_path)).collect()) == [(10 * key + 1, 10 * key + 2) for key in (1, 151, 10**9)]


def test_whole_texts_and_vectors(spark, tmp_path):
    words = [f"w{i}" for i in range(8)] + ["the", "longer", "of"]
    spark.createDataFrame([(0, " ".join(words)), (2, "@" + "x" * 50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, " ".join(words))], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    one, near, far = [1.0] * 64, [1.0] * 56 + [-1.0] * 8, [1.0] * 55 + [-1.0] * 9
    spark.createDataFrame([(1, one), (2, near), (3, far)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    first = next(r for r in run("array_set_ops") if r.doc_id == 0)
    assert (first.n_distinct, first.any_article, first.disjoint, first.n_long) == (11, True, False, 1)
    assert [r.word for r in sorted(run("explode_linked_tables"), key=lambda r: r.ord)] == words
    assert {r.guarded for r in run("csv_guard")} == {"'=" + " ".join(words), "'@" + "x" * 50}
    assert sorted((r.left, r.right, r.distance) for r in run("embedding_sign_hamming")) == [(1, 2, 8), (2, 3, 1)]


def test_heading_titles(spark):
    pages = ["<title>t</title>", "<h1>A</h1><h2 class='x'> B </h2><h3>A</h3><h4>no</h4>", "".join(f"<h2>{x}</h2>" for x in "DCBDA"), "<h1> </h1>", None]
    got = spark.createDataFrame([(p,) for p in pages], "html string").select(text.heading_title(F.col("html"))).collect()
    assert [r[0] for r in got] == [None, "A, B", "D, C, B and more", None, None]
