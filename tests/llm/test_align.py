"""Alignment of two tokenizers against a plain version over all pairs, with the libraries' own encodings."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerline.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None,
    "",
    " ",
    "  two  spaces and a tail ",
    "a\n b\t \nc \r\n",
    "<|endoftext|> <s> </s> <unk>",
    "the▁mark",
    "naïve Étude 日本語 テキスト 🙂🙂 é ﬁ   　x",
    "=" * 3000,
    "the cat and the cat and the dog",
    "the cat and the cat and the dog",
    "\x00\x01 odd\x7f",
    "don't we'll I'm 'quoted'   ",
]


def plain(texts):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    signs = {v: k for k, v in {x: c for c, x in align.byte_signs().items()}.items()}
    rows, held = [], defaultdict(int)
    for t in texts:
        raw = (" " + (t or "")).encode()
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ba = [bytes(signs[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not t or b"".join(ba) != raw or b"".join(bb) != raw:
            rows.append(None)
            continue
        ends = lambda x: list(accumulate(map(len, x)))
        ea, eb = ends(ba), ends(bb)
        cuts = sorted(set(ea) & set(eb))
        of = {c: k for k, c in enumerate(cuts)}
        groups, k = [([], []) for _ in cuts], 0
        for side, (ids, at) in enumerate(((ia, ea), (ib, eb))):
            k = 0
            for i, e in zip(ids, at):
                groups[k][side].append(i)
                k += e in of
        pairs = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        for k in pairs:
            held[k] += 1
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(ia), len(ib), len(groups), pairs, hashlib.sha256(said.encode()).hexdigest()))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, pairs, digest = r
        out.append((n_a, n_b, n_groups, sum(pairs.values()), sum(n for k, n in pairs.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in pairs.items()), digest))
    return out


def digests(df):
    names = [c for c, _ in align.COLUMNS]
    return {r.doc_id: tuple(r[c] for c in names) for r in df.collect()}


def test_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    assert digests(align.align(docs, A, B)) == dict(enumerate(plain(ODD)))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], plain([r.text for r in rows]), strict=True))
    assert digests(align.align(docs, A, B)) == want


def test_nulls_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, "one text", "x"), (None, "one text", "y"), (1, None, None)], "doc_id long, text string, n_links string")
    got = align.align(docs, A, B)
    assert got.columns == ["doc_id", *(c for c, _ in align.COLUMNS)]
    rows = sorted((r.doc_id is None, r.n_links, r.n_best, r.count_sum) for r in got.collect())
    assert rows == [(False, 0, 0, 0), (True, 2, 2, 4), (True, 2, 2, 4)]
    assert align.align(docs.where("false"), A, B).count() == 0
    with pytest.raises(ValueError):
        align.align(docs.withColumnRenamed("n_links", "__at"), A, B)


def test_small_blocks_and_a_full_table_of_parts_change_nothing(spark, monkeypatch):
    texts = [f"word{i % 7} and the{i % 3}  again {'x' * i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = digests(align.align(docs, A, B))
    assert want == dict(enumerate(plain(texts)))
    monkeypatch.setattr(align, "BLOCK_BYTES", 64)
    assert digests(align.align(docs, A, B)) == want
    with open(A) as f, open(B, "rb") as g:
        made = align.Aligner(align.ByteLevel(f.read()), align.Pieces(g.read()))
    whole = [made.align([t])[0][:4] for t in texts]
    monkeypatch.setattr(align, "KNOWN_CHARS", 10)
    assert [made.align([t])[0][:4] for t in texts] == whole
    # what is kept of a table that shrinks is aligned as before
    monkeypatch.setattr(align, "KNOWN_CHARS", 150)
    assert [x[:4] for k in range(0, 60, 5) for x in made.align(texts[k : k + 5])] == whole and len(made.number) < 60
    assert [made.align([t])[0][:4] for t in texts[::-1]] == whole[::-1]
    made.apart = False
    made.clear()
    assert [made.align([t])[0][:4] for t in texts] == whole


def test_sums_of_pairs():
    import numpy as np

    r = np.random.default_rng(2)
    for most in (5, 1 << 30):
        pairs, times = r.integers(0, 1 << 38, 50)[r.integers(0, 50, 400)], r.integers(1, most, 400)
        key, total = align.summed(pairs, times)
        assert key.tolist() == sorted(set(pairs.tolist())) and total.tolist() == [int(times[pairs == k].sum()) for k in key]
    assert [len(x) for x in align.summed(pairs[:0], times[:0])] == [0, 0]
