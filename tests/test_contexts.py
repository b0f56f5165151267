"""Contexts over graphs and report units against plain walks and loops."""

import random

from pyspark.sql import functions as F

from ledgerline.operators import contexts

NODES, LINKS = "node long, scope string, status string, source_valid boolean", "node long, role string, target long, entity string"


def plain(nodes, links, most_depth, most_nodes):
    known = {n[0]: n for n in nodes}
    own = {}
    for link in set(links):
        if link[0] in known and link[1] is not None:
            own.setdefault(link[0], []).append(link)
    bad = lambda x: x[2] is not None and (x[2] not in known or known[x[2]][1] != known[x[0]][1] or x[2] == x[0])
    good = {n: {x[2] for x in xs if x[2] is not None and not bad(x)} for n, xs in own.items()}

    def levels(root):
        front, seen = set(good.get(root, ())), set(good.get(root, ()))
        yield front, seen
        for _ in range(most_depth):
            front = set().union(*(good.get(x, set()) for x in front)) if front else set()
            seen = seen | front
            yield front, seen

    walks = {n: list(levels(n)) for n in known}
    bound = {n: {(x[1], x[3]) for x in own.get(n, ()) if x[2] is not None and not bad(x) and x[3] is not None} for n in known}
    out = {}
    for n in known:
        seen, left = walks[n][-1][1], walks[n][-1][0]
        many = any(len(s) > most_nodes for _, s in walks[n])
        ring = any(x in walks[x][-1][1] and not any(len(s) > most_nodes for _, s in walks[x]) for x in seen)
        context = sorted(set(bound[n]).union(*(bound[x] for x in seen))) if seen else sorted(bound[n])
        reason = (
            "too_many" if many else "cycle" if ring else "too_deep" if left
            else "bad_link" if any(bad(x) for y in [n, *seen] for x in own.get(y, ()))
            else "source" if any(not known[x][3] for x in seen)
            else "conflict" if len({r for r, _ in context}) < len(context) else None
        )
        if reason:
            state = "INVALID"
        elif any(x[2] in known and known[x[2]][2] == "EXCLUDED" for x in own.get(n, ())):
            state = "EXCLUDED"
        elif any(x[2] is None for x in own.get(n, ())):
            state = "UNLINKED"
        elif any(known[x][2] != "CONFIRMED" or any(y[2] is None for y in own.get(x, ())) for x in seen):
            state = "UNREVIEWED"
        else:
            state = "RESOLVED"
        stopped = reason in ("too_many", "cycle", "too_deep")
        out[n] = (state, reason, [] if stopped else sorted(seen), [] if stopped else context)
    return out


def got(spark, nodes, links, **kw):
    rows = contexts.resolve(spark.createDataFrame(nodes, NODES).repartition(3), spark.createDataFrame(links, LINKS).repartition(3), **kw).collect()
    assert len(rows) == len({r.node for r in rows}) and all(r.n_dependencies == len(r.dependencies) for r in rows)
    return {r.node: (r.state, r.reason, list(r.dependencies), [(x.role, x.entity) for x in r.context]) for r in rows}


def test_each_state(spark):
    n = lambda i, status="CONFIRMED", valid=True, scope="r": (i, scope, status, valid)
    nodes = [n(1), n(2), n(3), n(4, "EXCLUDED"), n(5), n(6), n(7), n(8, scope="other"), n(9), n(10), n(11), n(12), n(13, valid=False), n(14), n(15), n(16)]
    links = [(2, "SPECIMEN", 1, "a"), (3, "ASSAY", 2, "b"), (5, "SPECIMEN", 4, "x"), (6, "MARKER", 5, "m"), (7, "SPECIMEN", None, None), (9, "ASSAY", 8, "z"), (10, "MARKER", 3, "m"), (10, "SPECIMEN", 4, "c"),
             (11, "ASSAY", 12, "p"), (12, "ASSAY", 11, "q"), (14, "ASSAY", 13, "s"), (15, "MARKER", 7, "t"), (16, "MARKER", 99, "t"), (16, "MARKER", 99, "t"), (None, "ASSAY", 1, "n"), (1, None, 2, "n")]
    found = got(spark, nodes, links)
    assert found == plain(nodes, links, 8, 32)
    assert found[3] == ("RESOLVED", None, [1, 2], [("ASSAY", "b"), ("SPECIMEN", "a")])
    assert [found[i][0] for i in (5, 6, 7, 15)] == ["EXCLUDED", "UNREVIEWED", "UNLINKED", "UNREVIEWED"]
    assert [found[i][1] for i in (9, 10, 11, 14, 16)] == ["bad_link", "conflict", "cycle", "source", "bad_link"]


def test_random_graphs_with_many_parents_and_cycles(spark):
    r = random.Random(4)
    nodes, links = [], []
    for i in range(400):
        nodes.append((i, f"s{i // 40}", r.choice(["CONFIRMED"] * 9 + ["PENDING", "EXCLUDED", None]), r.random() < 0.98))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            base = i // 40 * 40
            target = r.choice([r.randrange(base, i + 1), r.randrange(base, i + 1), r.randrange(base, base + 40) if r.random() < 0.2 else None, i - 1])
            links.append((i, r.choice(["SPECIMEN", "ASSAY", "MARKER"]), target, f"e{(target or 0) // 20}"))
    for kw in ({}, {"most_depth": 3, "most_nodes": 6}):
        want = plain(nodes, links, kw.get("most_depth", 8), kw.get("most_nodes", 32))
        assert got(spark, nodes, links, **kw) == want
    assert len({v[1] for v in want.values()}) >= 6
    assert got(spark, [], []) == {}
    assert got(spark, nodes[:2], []) == plain(nodes[:2], [], 8, 32)


def loop(rows):
    """Units of one document by going through its lines."""
    starts, seen = [0], False
    for i, (title, *_) in enumerate(rows):
        if title and seen:
            at = i
            if at and rows[at - 1][1]:
                at -= 1
            if at and rows[at - 1][4]:
                at -= 1
                if at and rows[at - 1][1] and not rows[at - 1][0]:
                    at -= 1
            if at > starts[-1]:
                starts.append(at)
        seen |= title
    cuts = set()
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        results = [i for i in range(a, b) if rows[i][3]]
        for x, y in zip(results, results[1:]):
            marks = [i for i in range(x + 1, y) if rows[i][2]]
            if marks and any(rows[i][2] for i in range(a, x)):
                heads = [i for i in range(x + 1, marks[0]) if rows[i][1]]
                cuts.add(heads[-1] if heads else marks[0])
    cuts |= set(starts)
    return [sum(s <= i for s in cuts) for i in range(len(rows))]


def test_units_equal_a_plain_loop(spark):
    r = random.Random(6)
    data, want = [], {}
    for doc in range(300):
        rows = [tuple(r.random() < p for p in (0.12, 0.2, 0.2, 0.3, 0.12)) for _ in range(r.randrange(1, 40))]
        want |= {(doc, i): u for i, u in enumerate(loop(rows))}
        data += [(doc, i // 9, i % 9, *(x if x or r.random() < 0.5 else None for x in row)) for i, row in enumerate(rows)]
    df = spark.createDataFrame(data, "doc long, page int, line int, title boolean, head boolean, marker boolean, result boolean, counter boolean").repartition(5)
    found = contexts.units(df, "doc", ["page", "line"])
    assert found.columns == [*df.columns, "unit"]
    assert {(x.doc, x.page * 9 + x.line): x.unit for x in found.collect()} == want
    assert max(want.values()) > 4
    assert contexts.units(df.where("false"), "doc", ["page", "line"]).count() == 0
    one = contexts.units(df.where("doc < 3").withColumn("doc", F.lit(None).cast("long")).withColumn("unit", F.lit("x")), "doc", ["page", "line"])
    assert one.where("unit IS NULL").count() == 0 and dict(one.dtypes)["unit"] == "int"
