"""Centroid clustering against plain rounds over all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest

from ledgerline.llm import centroids


def plain(rows, k, rounds, scale, width, seed=3):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [list(v) for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, x), n) for n, x in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, g in groups.items():
            c[n] = [sum(x) // len(g) for x in zip(*g)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    own = {}
    for _, n, d in out:
        own[n] = own.get(n, 0) + d
    return sorted(((i, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, n, d in out), key=repr)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", centroids.F.lit("own")).repartition(3)
    return sorted((tuple(r) for r in centroids.cluster(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("k,rounds,scale", [(1, 2, 8), (5, 6, 8), (12, 10, 2), (8, 10, 1024), (4, 6, 1 << 22)])
def test_against_plain_rounds(spark, k, rounds, scale):
    r = random.Random(k)
    middle = [[r.gauss(0, 3) for _ in range(4)] for _ in range(5)]
    rows = [(i, [m + r.gauss(0, 1) for m in middle[r.randrange(5)]]) for i in range(400)]
    rows += [(i, [float(round(x)) for x in e]) for i, e in rows[:100]] + rows[:40]  # ties, repeated ids and rows
    assert found(spark, rows, k=k, rounds=rounds, scale=scale, width=4) == plain(rows, k, rounds, scale, 4)


def test_rows_that_take_no_part_and_null_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (None, [3.0, 4.0]), (None, [3.0, 4.0]), (7, [1.0, 2.0, 3.0]), (8, [])]
    for k in (1, 2, 8):
        assert found(spark, rows, k=k, rounds=3, scale=10, width=2) == plain(rows, k, 3, 10, 2)
    assert found(spark, rows[1:6], k=2, rounds=3, scale=10, width=2) == []
    with pytest.raises(ValueError):
        found(spark, [(1, [1e30, 1.0])], k=1, rounds=1, scale=1024, width=2)


def test_all_equal_norms_and_boundary_ties(spark):
    rows = [(i, [math.cos(i) * 7, math.sin(i) * 7]) for i in range(200)] + [(1000 + i, [float(x), float(y)]) for i, (x, y) in enumerate([(3, 4), (-3, 4), (4, 3), (0, 5), (5, 0), (0, -5), (0, 0)] * 5)]
    assert found(spark, rows, k=8, rounds=10, scale=1, width=2) == plain(rows, 8, 10, 1, 2)


def test_annulus_leaves_out_what_is_too_far():
    c = np.array([[0, 0], [10, 0], [1000, 0], [0, 12]])
    search = centroids.Annulus(c, True)
    number, d = search.nearest(np.array([[9.0, 0.0], [5.0, 0.0], [0.0, 11.0]]))
    assert number.tolist() == [1, 0, 3] and d.tolist() == [1, 25, 1]
    number, _ = search.nearest(np.array([[5.0, 0.0]]), np.array([1]))
    assert number.tolist() == [0]
