"""Top-k against all scores; token files against the tokenizers library."""

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from ledgerline.llm import tokenids, topk  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The cats  naïve,\n42 Ways!! of\tÉtude", "", None, "don't <|endoftext|> we're", "ÀÉÑ×÷ÿß x_y 1234 5.6%%% a\x00b", "日本語 текст ﬁ é İ ²³½ «q»",
    "A" * 70_000, " \n\t ", "a", "a\x1cb c\x1d", "word " * 30_000, "the the the", "the the the", "''' <| |>",
]


def test_encoder_equals_the_library():
    made = tokenids.Encoder(tokenids.definition_of(PATH))
    assert made.plain
    t = Tokenizer.from_file(PATH)
    want = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u2").tobytes() for x in TEXTS]
    assert list(made.encode(pa.array(TEXTS))) == want
    made.pieces.most = 3  # the table starts afresh again and again
    assert list(made.encode(pa.array(TEXTS))) == want


def test_files_round_trip(spark, tmp_path):
    docs = [(k * 7 % 101, t) for k, t in enumerate(TEXTS * 3)] + [(None, "no id"), (-5, "low")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS file")
    got = tokenids.write_and_read(df, PATH).orderBy("start").collect()
    t = Tokenizer.from_file(PATH)
    assert [r.doc_id for r in got] == sorted((k for k, _ in docs), key=lambda k: (k is not None, k or 0))
    at, seen = 0, []
    for r in got:
        assert r.start == at
        at += r.n_tokens
        seen.append((r.doc_id, r.n_tokens, r.ids_crc32))
    want = []
    for k, x in docs:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((k, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    assert tokenids.write_and_read(df.limit(0), PATH).collect() == []


def test_one_document_is_read_alone_and_only_with_its_dictionary():
    arrays = [np.arange(i % 50, dtype="<u2").tobytes() for i in range(300)]
    dictionary = tokenids.train_dictionary(arrays, 4096)
    shard = tokenids.Shard(dictionary, 2)
    for i, a in enumerate(arrays):
        shard.add(i if i else None, a)
    raw = shard.bytes()
    reader = tokenids.ShardReader(raw, dictionary)
    assert reader.n == 300 and reader.key(0) is None and reader.key(7) == 7
    assert reader.ids(137).tolist() == list(range(137 % 50)) and reader.ids(0).tolist() == []
    with pytest.raises(ValueError):
        tokenids.ShardReader(raw, b"other")
    with pytest.raises(ValueError):
        tokenids.ShardReader(raw[:-1], dictionary)


def plain_top(rows, k, query):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for qi, q in ok:
        if query(qi):
            best = sorted(((-score(q, v), i) for i, v in ok if i != qi))[:k]
            out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_k_matches_all_scores(spark, spread):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * np.exp(spread * rng.normal())).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, rows[3][1]) for i in range(150)] + [(1000, None), (1010, [None] * 16), (1020, [float("nan")] * 16), (1030, [float("inf")] + [0.0] * 15), (1040, [1.0, 2.0]), (1050, []), (None, rows[0][1])]
    df = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS rank", "3 AS score"))
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 10 = 0"), 5).collect())
    assert got == plain_top(rows, 5, lambda i: i % 10 == 0)


def test_top_k_of_few_and_none(spark):
    df = topk.integer_vectors(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df, df.limit(0)).collect() == []
    assert topk.top_k(df.limit(0), df).collect() == []


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    df = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 4 = 0"), 3).collect())
    assert got == plain_top(rows, 3, lambda i: i % 4 == 0)


def test_large_scores_are_exact(spark):
    """Scores past 2 ** 53, where doubles are no longer exact; past 2 ** 63 there is an error."""
    rng = np.random.default_rng(12)
    rows = [(i, (rng.choice([-1.0, 1.0], 8) * (2.0**20 + rng.integers(0, 3, 8) / 256)).tolist()) for i in range(120)]
    df = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 4 = 0"), 3).collect())
    assert got == plain_top(rows, 3, lambda i: i % 4 == 0) and max(r[3] for r in got) > 1 << 53
    huge = topk.integer_vectors(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="2 .. 63"):
        topk.top_k(huge, huge, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB9 .,'-_<|>\n\tÀßé×\x00\x1c日я"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=12))
def test_encoder_equals_the_library_on_any_text(texts):
    made, t = _encoder()
    assert list(made.encode(pa.array(texts, pa.string()))) == [np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u2").tobytes() for x in texts]


@functools.cache
def _encoder():
    return tokenids.Encoder(tokenids.definition_of(PATH)), Tokenizer.from_file(PATH)
