"""The stages over awkward documents: columns, decisions, empty tables."""

from collections import Counter

import numpy as np

import corpus_pipeline
from meshflux.llm import mixing, simhash
from tests.llm.conftest import awkward, documents, low, prose, solid

ROWS = awkward()


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.Lineage(spark).cut(stage(spark, docs, folder))
        assert docs.count() > 0
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert [c for c in docs.columns if c in columns] == columns and {"shard", "slot"} <= set(docs.columns)
    placed = docs.select("shard_", "slot").collect()  # the documents have a column shard of their own
    assert len(set(placed)) == len(placed) > 0 and {r.shard_ for r in placed} <= set(range(16))


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_near_duplicates(spark):
    """One row of each group stays, whatever is repeated; unlike texts stay."""
    base = prose("near", 600)
    words = base.split()
    words[300] = "changed"
    rows = [(1, base, "s"), (2, base, "s"), (2, base, "s"), (3, " ".join(words), "s"), (4, base.upper(), "s"), (5, prose("far", 600), "s"), (6, None, "s"), (7, "", "s"), (None, base, "s")]
    kept = simhash.keep_one(spark, documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(1, base), (5, prose("far", 600)), (6, None)] and len(kept) == 3


def test_near_duplicates_by_brute_force(spark):
    """No two rows that stay are equal; every row that goes is alike, through others, to one that stays."""
    kept = simhash.keep_one(spark, documents(spark, ROWS)).collect()

    def shingles(t):
        w = solid(t)
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    texts = Counter(" ".join(solid(t)) for _, t, _ in ROWS)
    stay = [" ".join(solid(r.text)) for r in kept]
    assert len(stay) == len(set(stay))
    sets = {t: shingles(t) for t in texts}

    def alike(a, b):
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    reached = set(stay)
    while more := {t for t in texts if t not in reached and any(alike(t, r) for r in reached)}:
        reached |= more
    assert reached == set(texts)
    lonely = {t for t in texts if not any(alike(t, u) for u in texts if u != t)}
    assert lonely <= set(stay)


def shingle_sets(texts):
    words = [t.split() for t in texts]
    return [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]


def groups(texts, linked):
    """The smallest number that each text reaches over linked pairs."""
    sets = shingle_sets(texts)
    label = list(range(len(texts)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if linked(i, j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((top(i), top(j)))
                label[high] = low
    return [top(k) for k in range(len(texts))]


def test_dense_families_by_brute_force(spark):
    """Texts within the distance that are similar end in one group, whatever lies between them."""
    draw = np.random.Generator(np.random.PCG64(5))
    base, texts = [f"w{k}" for k in range(300)], []
    for _ in range(250):  # some words of a few places are changed, in one of two ways
        words = list(base)
        for k in draw.choice(40, int(draw.integers(5, 8)), replace=False) * 7:
            words[k] = f"x{k}way{draw.integers(0, 2)}"
        texts.append(" ".join(words))
    fps = [simhash.fingerprint(t.encode(), 5) & (1 << 64) - 1 for t in texts]
    near = groups(texts, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 7)
    kept = {r.doc_id for r in simhash.keep_one(spark, documents(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    assert kept <= set(near)  # of each group one stays, at most
    assert set(groups(texts, lambda i, j: True)) <= kept


def test_pairs_near_the_threshold(spark):
    """Pairs with a Jaccard similarity from 0.8 to 0.9 are found, whatever their fingerprints."""
    draw = np.random.Generator(np.random.PCG64(6))
    texts = []
    for pair in range(120):
        words = [f"p{pair}w{k}" for k in range(200)]
        texts.append(" ".join(words))
        for k in draw.choice(40, 2 + pair % 3, replace=False) * 5:
            words[k] = "changed"
        texts.append(" ".join(words))
    kept = {r.doc_id for r in simhash.keep_one(spark, documents(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    assert kept == set(groups(texts, lambda i, j: i // 2 == j // 2)) == set(range(0, 240, 2))


def test_contaminated_go(spark, folder):
    docs = documents(spark, ROWS)
    kept = corpus_pipeline.drop_contaminated(spark, docs, folder).collect()
    item = " ".join(ROWS[10][1].split()[:20])
    assert len(kept) == len(ROWS) - sum(low(item) in low(t) for _, t, _ in ROWS)


def test_mix_meets_targets(spark):
    draw = np.random.Generator(np.random.PCG64(8))
    rows = [(i, prose(i, int(draw.integers(0, 80))), f"s{i % 3}") for i in range(900)]
    docs = documents(spark, rows)
    out = corpus_pipeline.mix_sources(spark, docs, "").collect()
    aims = {r.source: r.target for r in mixing.mix(spark, docs).collect()}
    got = Counter()
    for r in out:
        got[r.source] += len(solid(r.text))
    assert all(abs(got[s] - aims[s]) <= 80 for s in aims)
    assert max(Counter(r.doc_id for r in out).values()) <= 2
