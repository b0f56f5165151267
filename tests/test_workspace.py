"""Clusters under all-pairs constraints and change tokens against plain versions."""

import random

from ledgerline.operators import joins, workspace


def plain_clusters(pairs, nodes):
    joined = {(g, min(a, b), max(a, b)) for g, a, b in pairs}
    out = {}
    for g in {g for g, _ in nodes}:
        clusters = []
        for x in sorted({n for k, n in nodes if k == g}):
            home = next((c for c in clusters if all((g, y, x) in joined for y in c)), None)
            clusters.append([x]) if home is None else home.append(x)
        out |= {(g, x): c[0] for c in clusters for x in c}
    return out


def clusters(spark, pairs, nodes):
    rows = joins.complete_link(spark.createDataFrame(pairs, "g string, left long, right long").repartition(4), spark.createDataFrame(nodes, "g string, node long").repartition(4), "g").collect()
    found = {(r.g, r.node): r.cluster for r in rows}
    assert len(found) == len(rows)
    return found


def test_clusters_of_random_groups(spark):
    r = random.Random(1)
    nodes = [(g, i) for g in "abc" for i in range(60)] + [("d", 5)]
    pairs = [(g, *r.sample(range(64), 2)) for g in "abc" for _ in range({"a": 60, "b": 400, "c": 1500}[g])]
    known = {n for _, n in nodes}
    want = plain_clusters([p for p in pairs if p[1] in known and p[2] in known], nodes)
    assert clusters(spark, pairs + pairs[:50], nodes + nodes[:5] + [(None, 3), ("a", None)]) == want
    assert clusters(spark, pairs[:0], nodes) == {k: k[1] for k in want}
    assert clusters(spark, pairs[:0], nodes[:0]) == {}


def test_a_chain_and_a_group_of_100000(spark):
    chain = [("a", i, i + 1) for i in range(300)]
    assert clusters(spark, chain, [("a", i) for i in range(301)]) == {("a", i): i // 2 * 2 for i in range(301)}
    # blocks of ten whose members are all paired, each tied to the next by one pair that makes no cluster
    n = 100_000
    ids = spark.range(n).selectExpr("'one' AS g", "id AS node")
    pairs = spark.range(n).selectExpr("'one' AS g", "id AS left", "explode(sequence(id + 1, least(id DIV 10 * 10 + 9, id + 9))) AS right").where("right > left")
    pairs = pairs.union(spark.range(0, n - 10, 20).selectExpr("'one' AS g", "id + 9 AS left", "id + 10 AS right"))
    found = joins.complete_link(pairs, ids, "g")
    assert found.where("cluster <> node DIV 10 * 10").count() == 0 and found.count() == n


def test_components(spark):
    r = random.Random(3)
    pairs = [(g, r.randrange(200), r.randrange(200)) for g in "ab" for _ in range(90)] + [("c", i, i + 1) for i in range(500)] + [(None, 1, 2), ("a", None, 1)]
    label = {}
    for g, a, b in pairs:
        if g is not None and a is not None and a != b:
            label.setdefault((g, a), a)
            label.setdefault((g, b), b)
    changed = True
    while changed:
        changed = False
        for g, a, b in pairs:
            if (g, a) in label and (g, b) in label and a != b and label[g, a] != label[g, b]:
                label[g, a] = label[g, b] = min(label[g, a], label[g, b])
                changed = True
    got = joins.components(spark.createDataFrame(pairs, "g string, left long, right long"), ["g"]).collect()
    assert {(x.g, x.node): x.component for x in got} == label and len(got) == len(label)


def test_tokens_and_confirmations(spark):
    units = [("p", i, "ok") for i in range(6)] + [("q", 10, "ok"), ("q", 10, "ok")]
    relations = [("p", 0, 1, "JOINED"), ("p", 1, 2, "JOINED"), ("p", 0, 2, "JOINED"), ("p", 3, 4, "JOINED"), ("p", 4, 5, "CONFLICT")]
    rows = [(0, 1, "a", False), (2, 1, "b", True), (4, 1, "c", False), (10, 1, "d", None), (99, 1, "e", True)]

    def made(units=units, relations=relations, rows=rows, confirmed=()):
        return workspace.report_workspace(
            spark.createDataFrame(units, "scope string, unit long, state string").repartition(3),
            spark.createDataFrame(relations, "scope string, left long, right long, state string"),
            spark.createDataFrame(rows, "unit long, row long, state string, problem boolean"),
            spark.createDataFrame(list(confirmed), "report long, token string, at long"),
        )

    first = {r.report: r for r in made().collect()}
    assert {k: (r.n_units, r.n_rows, r.relation_conflict, r.n_problems) for k, r in first.items()} == {0: (3, 2, False, 1), 3: (2, 1, True, 0), 5: (1, 0, True, 0), 10: (2, 1, False, 0)}
    assert not any(r.confirmed for r in first.values())
    again = {r.report: r for r in made(units[::-1], relations[::-1], rows[::-1], [(0, "old", 5), (0, first[0].token, 6), (3, first[3].token, 6), (3, "new", 7)]).collect()}
    assert {k: r.token for k, r in again.items()} == {k: r.token for k, r in first.items()} and [again[k].confirmed for k in (0, 3, 5, 10)] == [True, False, False, False]
    other = made(rows=[*rows[:2], (4, 1, "changed", False), rows[3]], relations=[*relations[:4], ("p", 4, 5, "JOINED")], units=[*units, ("r", 20, "ok")])
    # 5 is joined with 4 only, so it stays by itself, but what touches it changed
    assert sorted(tuple(r) for r in workspace.tokens_differ(made(), other).collect()) == [("p", 3, "changed"), ("p", 5, "changed"), ("r", 20, "new")]
