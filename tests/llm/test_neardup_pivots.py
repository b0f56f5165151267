"""The near-dedup stage's fingerprints and pivot tables against plain versions."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import neardup
from ledgerline.llm.common import mix, text_chunks


def plain_fingerprint(hashes):
    """The bits set in over half of the hashes, one bit at a time."""
    out = []
    for plane in neardup._PLANE:
        own = [int(mix(np.array([h], np.uint64) ^ plane)[0]) for h in hashes]
        out.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in own) > len(own)))
    return out


def test_fingerprints_match_a_plain_simhash():
    texts = [None, "", "one", " ".join(f"w{i}" for i in range(8)), "", " ".join(f"v{i}" for i in range(262)), " ".join(f"u{i}" for i in range(514)), " "]
    for _, _, data, offs in text_chunks(pa.array(texts)):
        h, cuts = neardup.shingle_sets(data, offs)
        got = neardup.fingerprints_of(h, cuts)
        assert np.diff(cuts).tolist() == [0, 0, 1, 4, 0, 258, 510, 0]  # 255 and twice as many are where a count in a byte ends
        assert got.tolist() == [plain_fingerprint(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@pytest.mark.parametrize("shared,left,right", [(4, 1, 0), (4, 0, 1), (12, 2, 1), (20, 3, 2), (80, 10, 10), (800, 200, 0)])
def test_pairs_at_the_least_similarity_are_within_the_radius(shared, left, right):
    rng, far = np.random.default_rng(shared), []
    for _ in range(200):
        h = rng.integers(0, 1 << 63, shared + left + right, dtype=np.uint64)
        both = np.concatenate([h[: shared + left], h[:shared], h[shared + left :]])
        a, b = neardup.fingerprints_of(both, np.array([0, shared + left, len(both)]))
        far.append(int(neardup.distances(a, b)))
    assert max(far) <= neardup.RADIUS and abs(np.mean(far) - 0.155 * neardup.BITS) < 0.04 * neardup.BITS


def bucket(rng, groups=6, copies=40, strangers=60):
    fp, part = [], []
    for g in range(groups):
        base = rng.integers(0, 1 << 63, neardup.BITS // 64, dtype=np.uint64) * np.uint64(2)
        for _ in range(copies):
            flip = np.packbits(rng.random(neardup.BITS) < rng.uniform(0, 0.15)).view(np.uint64)
            fp.append(base ^ flip)
            part.append(g if rng.random() < 0.8 else 1000 + len(part))
    for _ in range(strangers):
        fp.append(rng.integers(0, 1 << 63, neardup.BITS // 64, dtype=np.uint64) * np.uint64(2))
        part.append(1000 + len(part))
    return rng.integers(90, 130, len(part)), np.array(part), np.array(fp)


def test_pivot_table_loses_no_pair_and_discards_strangers(monkeypatch):
    n, part, fp = bucket(np.random.default_rng(5))
    assert len(n) > 200
    whole = np.array([[int(neardup.distances(a, b)) for b in fp] for a in fp])
    alike = np.minimum(n[:, None], n) >= 0.8 * np.maximum(n[:, None], n) - 1e-9
    may = (part[:, None] != part) & alike & np.triu(np.ones_like(alike), 1)
    looked, plain = [], neardup.distances
    monkeypatch.setattr(neardup, "distances", lambda a, b: looked.append(len(a) if b.ndim == 2 else 0) or plain(a, b))
    i, j = neardup.near_of_bucket(n, part, fp, 0.8)
    want = set(zip(*(x.tolist() for x in np.nonzero(may & (whole <= neardup.RADIUS))), strict=True))
    assert want and set(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert sum(looked) < may.sum() / 2  # the table discards most pairs before their bits are looked at
