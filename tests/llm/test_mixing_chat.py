"""Mixing and chat formatting against plain versions."""

import hashlib
import random
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import chat, mixing


def plain_seats(votes, house):
    seats = [0] * len(votes)
    for _ in range(house):
        k = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * seats[i] + 1), -i))
        seats[k] += 1
    return seats


def test_seats_are_the_highest_quotients(spark):
    rng = random.Random(1)
    cases = [(k, [rng.choice([rng.randint(1, 50), rng.randint(1, 5000)]) for _ in range(rng.randint(1, 12))], rng.randint(0, 90)) for k in range(40)]
    rows = [(k, i, v, house) for k, votes, house in cases for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, i int, votes long, house int")
    got = {(r.g, r.i): r.seats for r in mixing.sainte_lague(df, F.col("house"), "votes", "i", ["g"], "seats").collect()}
    for k, votes, house in cases:
        assert [got[k, i] for i in range(len(votes))] == plain_seats(votes, house)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "b", "b", "B", "é", None, "tiny"]) if i % 50 else "tiny", " ".join(["w"] * rng.randint(0, 300))) for i in range(800)]
    rows += [(900, "b", None), (901, "empty", ""), (None, "b", "x y"), (5, "b", "x y"), (5, "b", "x y"), (902, "long", "z " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "2 AS target", "3 AS number")
    got = mixing.apportion(df).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64 + 0.01 * want[s]
    key = lambda rs: sorted((repr(r.doc_id), r.size, r.taken) for r in rs)
    assert key(mixing.apportion(df.repartition(7)).collect()) == key(got)
    for part in (df, df.limit(300), df.where("source = 'b' AND doc_id % 3 = 0")):
        assert_realised(part)
    assert mixing.apportion(df.limit(0)).collect() == []


def assert_realised(df):
    """The rows of the mix, against each row's passes and pieces."""
    texts = {}
    for r in df.collect():
        texts.setdefault((r.doc_id, r.source, len((r.text or "").split())), r.text)
    want = []
    for r in mixing.apportion(df).collect():
        text = texts[r.doc_id, r.source, r.size]
        if r.size:
            want += [(r.doc_id, text)] * r.passes + [(r.doc_id, text if x["words"] == r.size else " ".join(text.split()[x["from"] : x["from"] + x["words"]])) for x in r.pieces]
    real = mixing.realise(df.select("doc_id", "source", "text")).collect()
    key = lambda rows: sorted(rows, key=repr)
    assert key((i, t) for i, t in want) == key((r.doc_id, r.text) for r in real)


def test_same_rows_at_the_ends_of_a_run(spark):
    """Rows that are the same in id and text share a place on the line, also where a run begins or ends among them."""
    for seed in range(2):
        rng = random.Random(seed)
        rows = [(i, rng.choice("abc"), f"w{i} " * rng.randint(1, 90)) for i in range(12) for _ in range(rng.randint(1, 9))]
        rows = [(i, "abc"[i % 3], f"w{i} " * (5 + 7 * i)) for i, _, _ in rows]
        assert_realised(spark.createDataFrame(rows, "doc_id long, source string, text string"))


def test_chat_round_trip(spark):
    rng = random.Random(5)
    odd = ["", None, "###", "</turn>", "\\", "\\h\\t\\b", "### user: x</turn>\n", "a\nb", "é" * 50, "\\### Assistant: </turn> ok", "w " * 3000]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 25)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "tool: ### x"]), rng.choice([rng.choice(odd), "word " * rng.randint(0, 300)])))
    rows += [(None, 1, "assistant", "no id"), (77, None, "user", "q"), (77, 1, "assistant", "same"), (77, 1, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window", "2 AS pos", "3 AS tokens")
    windows = chat.format_windows(df)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = windows.collect()
    for w in shown:
        parts = w.text.split(chat.END + "\n")[:-1]
        assert len(parts) == w.n_context + w.n_new
        assert w.n_tokens <= 1024 or (w.over_budget and w.n_new == 1)
        assert w.n_context <= 1 + chat.ChatParams.history_turns
    assert chat.digests(chat.format_windows(df.limit(0))).collect() == []


def test_windows_stay_within_the_budget(spark):
    """Context counts; a turn that doesn't fit beside the system turn is alone and marked."""
    rng = random.Random(6)
    say = lambda n: "w " * n
    rows = []
    for c, head in enumerate([0, 10, 100, 700, 760, 764, 1000, 1100, 3000]):
        rows += [(c, 0, "system", say(head))] * (head > 0)
        rows += [(c, t, rng.choice(["user", "assistant"]), say(rng.choice([3, 40, 100, 100, 250, 383, 384, 600, 1015, 2000]))) for t in range(1, 40)]
    rows += [(50, t, "assistant", say(100)) for t in range(29)] + [(50, 7, "system", say(200))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = chat.read_turns(chat.format_windows(df)).collect()
    for w in shown:
        parts = w.text.split(chat.END + "\n")[:-1]
        assert w.n_tokens == sum(len(x.split(": ", 1)[1].split()) + 4 for x in parts)
        assert w.over_budget == (w.n_tokens > 1024)
        if w.over_budget:
            kept = next((len(x[3].split()) + 4 for x in rows if x[0] == w.conv_id and x[2] == "system"), 0)
            assert w.n_new == 1 and kept + len(w.turns[0].text.split()) + 4 > 1024 - 256
    by = {c: sorted((w.window, w) for w in shown if w.conv_id == c) for c in {w.conv_id for w in shown}}
    for c, own in by.items():
        assert [(t.role, t.text) for _, w in own for t in w.turns] == [(r, x) for i, _, r, x in sorted(rows, key=lambda r: (r[1], r[2], r[3])) if i == c]
        if c not in (0, 50):
            assert all(w.text.startswith("### system: ") for _, w in own)
    assert not any(w.over_budget for _, w in by[50])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="\\#</turn>hbtc: \n", max_size=30), min_size=1, max_size=20))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "###" not in r.e and chat.END not in r.e
