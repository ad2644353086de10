"""Features and scores of toxicity, and differencing, against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from meshflux.llm import sharding, toxicity
from tests.llm.conftest import awkward, prose

PLAIN, DISGUISED = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[0-9A-Za-z@$!\x80-\xff]+")
WEIGHTS = {"w3": 2.0, "w17": 0.5, "villain": 3.5, "one": 1.25, "sis": 1.5, "é": 0.75, "you": 0.25}


def words_of(pattern, raw):
    return [(m.start(), m.group().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).decode()) for m in pattern.finditer(raw)]


def plain_features(text, weights):
    """Features of one text, word by word."""
    raw = (text or "").encode()
    words = words_of(PLAIN, raw)
    second = [w in toxicity.SECOND_PERSON for _, w in words]
    hits = [k for k, (_, w) in enumerate(words) if w in weights]
    near = sum(any(second[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]) for k in hits)
    undo = str.maketrans(toxicity.DISGUISES)
    open_starts = {words[k][0] for k in hits}
    hidden = sum(w.translate(undo) in weights and start not in open_starts for start, w in words_of(DISGUISED, raw))
    n, size = max(1, len(words)), max(1, len(raw))

    def held(chars):
        return sum(raw.count(c) for c in chars.encode())

    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = [weights[words[k][1]] for k in hits]
    return [
        sum(found) / n, len(hits) / n, math.log1p(len(hits)), max(found, default=0.0), near / max(1, len(hits)), sum(second) / n,
        held(capitals) / max(1, held(capitals + capitals.lower())), held("!?") / size, held("!\"'(),-.:;?") / size, held("#$%&*+/<=>@[\\]^_`{|}~") / size,
        hidden / n, math.log1p(hidden), math.log1p(len(words))]


def texts():
    planted = [
        "You VILLAIN, you!", "a b c d e f villain g h i j k you", "v1llain 51s! $i$ ONE", "one two three four five six your", "vi11ain villa!n v!lla!n one",
        "É é w3 W3 w17", "?!?!?", "@$!", " you ", "nothing here", "villain\nvillain\tyou " + "filler " * 50 + "sis", "x" * 300_000 + " you villain",
        prose(5, 70_000) + " v1llain", "x_one-one.one", "one" * 3]
    return planted + [t for _, t, _ in awkward()]


@pytest.mark.parametrize("slice_bytes", [64, 1 << 18])
def test_features_equal_plain_ones(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(toxicity, "_SLICE", slice_bytes)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.features for r in toxicity.features(docs, "text", toxicity.Lexicon.of(WEIGHTS)).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        want = plain_features(text, WEIGHTS)
        assert len(want) == len(toxicity.FEATURES)
        bad = [name for name, a, b in zip(toxicity.FEATURES, got[k], want, strict=True) if abs(a - b) > 1e-12 * max(1, abs(b))]
        assert not bad, (k, (text or "")[:60], bad)


def plain_lexicon(rows, toxic):
    """Lexical words of some texts: the lower bound of the log odds of a word, between texts that are toxic and others."""
    n_toxic, n_clean = max(1, sum(toxic.values())), max(1, len(toxic) - sum(toxic.values()))
    t, c = Counter(), Counter()
    for k, text in rows:
        (t if toxic[k] else c).update({w for _, w in words_of(PLAIN, text.encode())})
    found = {}
    for word in t:
        if t[word] >= toxicity.LEAST_TEXTS:
            x, y = t[word] + 0.5, c[word] + 0.5
            odds = math.log(x / (n_toxic + 1)) - math.log(y / (n_clean + 1))
            if (bound := odds - toxicity.QUANTILE * math.sqrt(1 / x + 1 / y)) > toxicity.LEAST_ODDS:
                found[word] = (-bound, word, min(8.0, odds))
    return {w: odds for _, w, odds in sorted(found.values())[: toxicity.LEXICON_WORDS]}


def test_lexicons_and_scores_equal_plain_ones(spark):
    def text(i):
        words = prose(i, 40).split()
        if i % 4 == 0:
            words[5:5] = ["You", ("rascal", "VILLAIN!", "knave", "w1")[i // 4 % 4]]
        return " ".join(words)

    rows = [(i, text(i)) for i in range(400)]
    toxic = {i: int(i % 4 == 0) for i, _ in rows}
    halves = {i: "ab"[zlib.crc32(b"%d" % i) % 2] for i, _ in rows}
    learned = spark.createDataFrame([(t, toxic[i], halves[i]) for i, t in rows], "text string, toxic int, half string")
    got = toxicity._lexicons(learned)
    for name in ("a", "b", "all"):
        own = [(i, t) for i, t in rows if name in ("all", halves[i])]
        want = plain_lexicon(own, {i: toxic[i] for i, _ in own})
        assert set(got[name]) == set(want) and {"rascal", "villain", "knave"} <= set(want)
        assert all(abs(got[name][w] - x) < 1e-12 for w, x in want.items())

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(spark, docs, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    # Learning draws no row out here and splits by a hash, so the lexicon is rebuilt from the hashes that the model holds.
    known = dict(zip(model.lexicon.hashes.tolist(), model.lexicon.weights.tolist(), strict=True))
    vocabulary = sorted({w for _, t in rows for _, w in words_of(PLAIN, t.encode())})
    hashes = toxicity.hash_of(vocabulary)
    weights = {w: known[h] for w, h in zip(vocabulary, hashes.tolist(), strict=True) if h in known}
    assert len(weights) == len(known)
    from pyspark.ml.linalg import Vectors

    bounds, values = list(model.calibration.boundaries), list(model.calibration.predictions)
    more = rows[:40] + [(1000, None), (1001, ""), (1002, "you r4scal"), (1003, "RASCAL you villain")]
    scored = {r.doc_id: r.score for r in model.score(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    for k, t in more:
        margin = float(model.trees.predictRaw(Vectors.dense(plain_features(t, weights)))[1])
        assert abs(scored[k] - min(1.0, max(0.0, float(np.interp(margin, bounds, values))))) < 1e-9, (k, t)


def plain_difference(parts):
    """The slots of the last partition, each the set of the (row, column) that it holds; every step looks at all partitions."""
    def ordered(slots):
        return sorted(slots, key=lambda s: -s[0])

    open_ = {i: ordered([(int(x), {(i, j)}) for j, x in enumerate(row)]) for i, row in enumerate(parts)}
    number = len(parts)
    while len(open_) > 1:
        first, second = sorted(open_, key=lambda i: (-(open_[i][0][0] - open_[i][-1][0]), i))[:2]
        a, b = open_.pop(first), open_.pop(second)
        open_[number] = ordered([(x + y, p | q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)])
        number += 1
    return next(iter(open_.values()))


@pytest.mark.parametrize("single", [True, False])
def test_differencing_equals_plain(single):
    draw = np.random.Generator(np.random.PCG64(11))
    for n in (1, 2, 3, 7, 60):
        for k in (1, 2, 5, 16):
            for most in (2, 9, 10_000):  # few sizes give ties
                parts = np.zeros((n, k), np.int64)
                parts[:, : 1 if single else k] = draw.integers(0, most, (n, 1 if single else k))
                place = sharding.difference(parts)
                for slot, (total, members) in enumerate(plain_difference(parts)):
                    assert members == set(zip(*(x.tolist() for x in np.nonzero(place == slot)), strict=True))
                    assert total == parts[place == slot].sum()


def test_differencing_is_never_far_from_the_best():
    """Every way to deal few groups, enumerated: at most 7/6 of the best largest part, the bound proved for two parts."""
    draw = np.random.Generator(np.random.PCG64(12))
    for _ in range(200):
        sizes = draw.integers(1, 50, 9)
        parts = np.zeros((9, 2), np.int64)
        parts[:, 0] = sizes
        place = sharding.difference(parts)[:, 0]
        best = min(max(w, sizes.sum() - w) for w in ((((m >> np.arange(9)) & 1) * sizes).sum() for m in range(256)))
        assert np.bincount(place, sizes, 2).max() <= 7 / 6 * best + 1e-9


def test_shards_of_many_documents_are_near_equal(spark):
    rows = [(i, prose(i, 5 + i * 7 % 90), "s") for i in range(3000)] + [(9000 + i, prose(1, 50), "s") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    totals = Counter()
    for r in sharding.assign(spark, docs).collect():
        totals[r.shard] += r.size
    assert len(totals) == 16 and max(totals.values()) - min(totals.values()) <= 0.001 * max(totals.values())


def test_shards_reach_the_texts_by_the_same_join_at_every_size(spark, tmp_path):
    spark.range(60).selectExpr("id AS doc_id", "concat('text ', id % 50) AS text", "'a' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.sharded(spark, docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(60)) and len({(r.shard, r.slot) for r in rows}) == 60
