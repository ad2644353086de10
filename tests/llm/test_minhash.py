"""Circulant MinHash classes against all pairs of sets."""

import itertools
import random

import numpy as np
import pytest

from meshflux.llm import minhash, queries, similar
from tests.llm.conftest import awkward, prose, solid


def plain_sets(rows):
    out = []
    for _, text, *_ in rows:
        words = solid(text)
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()})
    return out


def plain(rows, percent):
    sets = plain_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and shared * 100 >= percent * (len(sets[a]) + len(sets[b]) - shared):
            root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    out = []
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k]), (min(ids) if ids else None) if sets[k] else rows[k][0]) for k in members]
    return out


def key(rows):
    return sorted(tuple((x is None, x or 0) for x in r) for r in rows)


def test_whole_table(spark, folder):
    got = queries.QUERIES["op13_minhash"](spark, folder).collect()
    assert key(tuple(r)[:3] for r in got) == key(plain(awkward(), 85))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_families_near_the_threshold(spark):
    """Variants of a few texts around 0.85, one shared passage in many texts, and a large group of near copies."""
    draw, rows = random.Random(1), []
    for family in range(12):
        words = prose(family, 150, 5000).split()
        for _ in range(12):
            own = list(words)
            for _ in range(draw.randrange(4)):
                own[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    passage = prose("shared", 100, 5000)
    rows += [(len(rows) + k, prose(900 + k, 60, 5000) + " " + passage) for k in range(80)]
    rows += [(1000 + k, prose("copies", 300, 5000) + f" tail{k}") for k in range(200)]
    got = minhash.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert key(tuple(r)[:3] for r in got) == key(plain(rows, 85))


def test_parts_of_a_text(monkeypatch):
    text = prose(3, 500).encode()
    whole = minhash.shingles(text)
    for part in (1, 7, 64):
        monkeypatch.setattr(minhash.word_parts, "__defaults__", (part,))
        found = minhash.shingles(text)
        assert np.array_equal(found[0], whole[0]) and found[1] == whole[1]
    assert [len(minhash.shingles(t)[0]) for t in (b"", b" \n", b"a", b"a b c d", b"a b c d e", b"a a a a a a a")] == [0, 0, 1, 1, 1, 1]


def test_coordinates_are_shifts_of_one_permutation():
    hashes = minhash.shingles(prose(5, 40).encode())[0]
    dealt = (minhash.mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    want = [min(int(minhash._scattered(np.array([(int(d) + k) % 2**32], np.uint32))[0]) for d in dealt) for k in range(1, 9)]
    assert minhash.signature(hashes, 8).tolist() == want


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85, 0.95])
def test_coordinates_agree_as_often_as_sets(share):
    draw = np.random.default_rng(int(share * 100))
    union = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
    shared = int(400 * share)
    a, b = union[: shared + (400 - shared) // 2], np.concatenate([union[:shared], union[shared + (400 - shared) // 2 :]])
    agree = (minhash.signature(a, 4000) == minhash.signature(b, 4000)).mean()
    assert abs(agree - share) < 0.05


def test_sketches_hide_nothing_near():
    assert similar.most_differing(192, 85) == 41 and similar.most_differing(160, 80) > 16


def test_parities_never_hide():
    draw = np.random.default_rng(2)
    for n, apart in ((50, 3), (400, 60), (3000, 900), (9, 0)):
        union = draw.integers(0, 1 << 63, n + apart, dtype=np.uint64)
        a, b = union[:n], union[apart:]
        x, y = (similar.sketch(np.zeros(0, np.uint32), s)[similar.MINIMA :] for s in (a, b))
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
