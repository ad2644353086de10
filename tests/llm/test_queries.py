"""Every query against a plain version over the awkward documents, and over empty tables."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from meshflux.llm import decontaminate, kneser_ney, license_scan, mixing, queries, sequence_files, sharding, simhash, token_files, toxicity
from meshflux.llm.common import hash_runs, hash_words, text_buffers
from tests.llm.conftest import alnum, awkward, low, prose, solid

ROWS = awkward()


def run(spark, name, folder):
    return queries.QUERIES[name](spark, folder).collect()


def key(*parts):
    return tuple((x is None, x if x is not None else 0) for x in parts)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    df = queries.QUERIES[name](spark, empty)
    assert {"doc_id", "vec_id", "conv_id"} & set(df.columns) and df.collect() == []


def test_toxicity(spark, folder):
    rows = run(spark, "op1_toxicity", folder)
    assert sorted(key(r.doc_id) for r in rows) == sorted(key(d) for d, *_ in ROWS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_toxicity_learns_words_and_disguises(spark):
    def text(i):
        words = prose(i, 60).split()
        if i % 5 == 0:
            words[10:10] = ["you", "scoundrel" if i % 2 else "VILLAIN!"]
        return " ".join(words)

    docs = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.learn(spark, docs, labels)
    scores = {r.doc_id: r.score for r in model.score(docs).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((scores[i] >= 0.7) == (i % 5 == 0) for i in held)
    more = spark.createDataFrame([(1, "you " + prose(9001, 30) + " sc0undrel"), (2, prose(9001, 30)), (3, None)], "doc_id long, text string")
    flat = toxicity.features(more, "text", model.lexicon).collect()
    disguised = toxicity.FEATURES.index("disguised")
    assert flat[0].features[disguised] > 0 and flat[1].features[disguised] == 0 and not any(flat[2].features)


def test_toxicity_of_one_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.learn(spark, docs, labels).score(docs).collect()} < {0.5, 0.25, 1 / 6}


def test_token_counts(spark, folder):
    rows = run(spark, "op2_token_counts", folder)
    encode = token_files.encoder(token_files.VOCABULARY).encode_ordinary
    assert sorted(key(r.doc_id, r.n_tokens) for r in rows) == sorted(key(d, len(encode(t or ""))) for d, t, _ in ROWS)
    assert all(r.ended for r in rows)
    for file in {r.file for r in rows}:  # documents of a file follow each other
        own = sorted((r for r in rows if r.file == file), key=lambda r: r.ordinal)
        assert [r.ordinal for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(o.n_tokens + 1 for o in own[:k]) for k in range(len(own))]


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_separator_scan_across_blocks(spark, tmp_path, block):
    """Any block size, separators at both ends of blocks, a file that does not end with one, an empty file."""
    files = {"a": [5, 9, 9, 1, 2, 3, 9, 4, 4, 4, 4, 4, 4, 4, 4, 9, 7], "b": [9], "c": [1, 2], "d": [], "e": [9, 9, 9]}
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    listed = spark.createDataFrame([(str(tmp_path / n),) for n in files], "file string")
    blocks = token_files.scan_blocks(spark, listed, separator=9, block_tokens=block)
    got = {(r.file[-1], r.ordinal, r.start, r.n_tokens, r.ended) for r in token_files.count_tokens(token_files.Lineage(spark), blocks).collect()}
    want = set()
    for name, ids in files.items():
        start = ordinal = 0
        for k, i in enumerate(ids):
            if i == 9:
                want.add((name, ordinal, start, k - start, True))
                start, ordinal = k + 1, ordinal + 1
        if start < len(ids):
            want.add((name, ordinal, start, len(ids) - start, False))
    assert got == want


def test_license_scan(spark, folder):
    notice = list(license_scan.NOTICES)[1]
    cases = [(-1, "x " + notice), (-2, "MIT License, cc by. Apache License gnu general public license"), (-3, None), (-4, "cc by cc by"), (-5, "mit"), (-6, "CC-BY; mit licence")]
    docs = spark.createDataFrame(cases + [(d, t) for d, t, _ in ROWS], "doc_id long, text string")
    phrases = {tuple(p.split()): label for p, label in license_scan.PHRASES.items()}
    want = []
    for d, t in cases + [(d, t) for d, t, _ in ROWS]:
        words = alnum(t)
        places = [(k, label) for p, label in phrases.items() for k in range(len(words) - len(p) + 1) if tuple(words[k : k + len(p)]) == p]
        want.append((d, len(words), len(places), min(places, default=(None,))[0], max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))))
    rows = license_scan.scan(docs, ["doc_id"]).collect()
    assert sorted((key(*r[:6]) for r in rows)) == sorted(key(*w) for w in want)
    found = {r.doc_id: r for r in rows}
    assert found[-1].labels == "mit" and found[-1].score == 1.0 and found[-1].base_labels == ""
    assert found[-2].labels == "apache,cc-by,gpl,mit" and found[-3].score == 0.0
    assert len(run(spark, "op3_license_scan", folder)) == len(ROWS)


def test_matching_statistics():
    """Against every substring of the sequences."""
    from meshflux.llm.automaton import SuffixAutomaton

    sequences = [[1, 2, 3, 1, 2, 4], [2, 3, 1, 2, 3, 1], [1, 2, 3], [5], [1, 2, 3, 1, 2, 4]]
    automaton = SuffixAutomaton(sequences)
    parts = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a, len(s) + 1)}
    words = [1, 2, 3, 1, 2, 3, 1, 9, 2, 4, 4, 5, 1, 2, 3, 1, 2, 4, 1]
    for k, (length, state) in enumerate(automaton.statistics(words)):
        assert length == max(n for n in range(k + 2) if tuple(words[k + 1 - n : k + 1]) in parts)
        for number, end in automaton.ends[state].items():
            assert sequences[number][end - length : end] == words[k + 1 - length : k + 1]


def test_mixing(spark, folder):
    rows = run(spark, "op4_mixing", folder)
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += len(solid(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, rest = {s: 0.0 for s in order if not sizes[s]}, 1.5 * sum(sizes.values())
    while len(target) < len(order):
        free = [s for s in order if s not in target]
        part = {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if part[s] > 2 * sizes[s]]
        target.update({s: 2.0 * sizes[s] for s in over} if over else part)
        rest -= sum(2.0 * sizes[s] for s in over)
    source = {(d, len(solid(t))): s for d, t, s in ROWS}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert len(rows) == len(ROWS)
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in order)
    assert sorted(map(tuple, rows), key=lambda r: key(*r)) == sorted(map(tuple, run(spark, "op4_mixing", folder)), key=lambda r: key(*r))


def test_sainte_lague_by_single_seats():
    draw = np.random.Generator(np.random.PCG64(1))
    for _ in range(60):
        n, seats = int(draw.integers(1, 9)), int(draw.integers(0, 60))
        claims, caps = draw.integers(0, 50, n), draw.integers(0, 30, n)
        want = np.zeros(n, int)
        for _ in range(min(seats, int(caps[claims > 0].sum()))):
            open_ = [k for k in range(n) if claims[k] and want[k] < caps[k]]
            want[max(open_, key=lambda k: (claims[k] / (2 * want[k] + 1), -k))] += 1
        got = mixing.sainte_lague(claims, caps, seats)
        assert got.sum() == want.sum() and (got <= np.where(claims > 0, caps, 0)).all()
        # Equal up to ties of quotients.
        assert sorted(claims / (2 * got + 1)) == pytest.approx(sorted(claims / (2 * want + 1)), abs=1e-9) or list(got) == list(want)


def test_exact_dedup(spark, folder):
    groups = {}
    for d, t, _ in ROWS:
        groups.setdefault(low(t), []).append(d)
    want = []
    for t, ids in groups.items():
        top = max((d for d in ids if d is not None), default=None)
        want += [key(d, top, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    rows = run(spark, "op5_exact_dedup", folder)
    assert sorted(key(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == sorted(want)
    assert sum(r.kept for r in rows) == len(groups) and all(not r.kept or r.doc_id == r.keep_id for r in rows)


def test_exact_dedup_over_batches_and_collisions(spark, tmp_path):
    """State over several micro-batches and runs; a digest that many different texts share is split by whole texts."""
    from pyspark.sql import functions as F

    from meshflux.llm import exact_dedup

    texts = [f"text {i % 40} {'x' * (i % 3)}" for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.repartition(6).write.parquet(f"{tmp_path}/t.parquet")
    for digest in (exact_dedup.sha256, lambda t: F.substring(t, 1, 6).cast("binary")):
        got = {r.doc_id: (r.kept.doc_id, r.group_size) for r in exact_dedup.deduplicate(spark, f"{tmp_path}/t.parquet", digest, batch_bytes=1).collect()}
        assert got == {i: (max(k for k, u in enumerate(texts) if u == t), texts.count(t)) for i, t in enumerate(texts)}
    arrivals, state = f"{tmp_path}/arrivals", f"{tmp_path}/state"
    rows = [(i, "f", i, bytes([i % 4])) for i in range(20)]
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, "doc_id long, file string, row long, digest binary").write.mode("append").parquet(arrivals)
        exact_dedup.fold_stream(spark, arrivals, state, batch_bytes=1)
    assert {(bytes(r.digest)[0], r.kept.doc_id, r.group_size) for r in exact_dedup.read_state(spark, state).collect()} == {(k, 16 + k, 5) for k in range(4)}


def test_decontamination(spark, folder):
    item = prose("item", 30).split()
    def changed(*places):
        return " ".join("other" if k in places else w for k, w in enumerate(item))

    cases = {
        1: (prose(1, 30) + " " + " ".join(item).upper() + " " + prose(2, 30), True), 2: (" ".join(item[:13]), True), 3: (" ".join(item[:12]), False),
        4: (changed(3, 9, 15, 21, 27), True), 5: (changed(*range(0, 30, 3)), False), 6: (None, False), 7: ("", False), 8: ("is an item of seven words in all cases", True),
        9: ("an item of seven other words in all", False), 10: ("too short", False), 11: (" ".join(item) + " x " + " ".join(item), True),
        12: (prose("long", 50_000) + " " + " ".join(item), True), 13: (changed(6), True)}
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = decontaminate.overlaps(spark, docs, benchmark, ["doc_id"]).collect()
    assert {r.doc_id for r in rows} == {k for k, (_, hit) in cases.items() if hit}
    first = next(r for r in rows if r.doc_id == 1)
    assert (first.doc_start, first.doc_stop, first.common, first.coverage) == (30, 60, 30, 1.0)
    kept = decontaminate.clean(spark, docs.withColumnRenamed("text", "body"), benchmark, "body").collect()
    assert {r.doc_id for r in kept} == {k for k, (_, hit) in cases.items() if not hit}
    assert 11 in {r.doc_id for r in run(spark, "op6_decontaminate", folder)}


def test_two_substitutions_never_hide_a_window():
    words = np.arange(1, 14, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = [int(h[0]) for _, h in decontaminate.seed_hashes(words, 13)]
    for a in range(13):
        for b in range(13):
            other = words.copy()
            other[a] += np.uint64(1)
            other[b] += np.uint64(2)
            assert any(int(h[0]) == whole[k] for k, h in decontaminate.seed_hashes(other, 13))


def found_in(item, text):
    """Whether ``text`` overlaps ``item``; both are lists of words."""
    data = np.frombuffer(" ".join(text).encode(), np.uint8)
    return bool(list(decontaminate._search(decontaminate.Index([(1, " ".join(item))]), data, np.array([0, len(data)]))))


def test_substitutions_at_every_place():
    """An item that is copied with one or two words changed is found if 80 % of a stretch of min(13, its words) are equal."""
    for n in range(5, 21):
        item = [f"i{k}" for k in range(n)]
        for places in [*itertools.combinations(range(n), 1), *itertools.combinations(range(n), 2)]:
            text = [f"o{k}" if k in places else w for k, w in enumerate(item)]
            assert found_in(item, ["before"] * 3 + text + ["after"] * 3) == (5 * (n - len(places)) >= 4 * n), (n, places)
    for n, places in ((20, range(0, 20, 5)), (20, (8, 9, 10, 11)), (24, (3, 9, 15, 21)), (30, range(2, 30, 5)), (15, (3, 7, 11))):
        item = [f"i{k}" for k in range(n)]
        text = [f"o{k}" if k in places else w for k, w in enumerate(item)]
        assert found_in(item, text) and found_in(item, ["x", *text, "y"])
    assert not found_in([f"i{k}" for k in range(20)], [f"o{k}" if k % 3 == 1 else f"i{k}" for k in range(20)])


def test_seeds_miss_no_stretch():
    """Every stretch of 13 to 25 words with a fifth of them changed agrees with itself unchanged in some seed."""
    kept = [tuple(p for p in range(13) if p not in some) for some in decontaminate.IGNORED] + decontaminate.FURTHER
    for n in range(13, 26):
        changed = np.array([sum(1 << p for p in c) for c in itertools.combinations(range(n), n // 5)])
        found = np.zeros(len(changed), bool)
        for seed in kept:
            mask = sum(1 << p for p in seed)
            for shift in range(n - seed[-1]):
                found |= changed & (mask << shift) == 0
        assert found.all()


def test_sequence_files(spark, folder):
    tokenizer = sequence_files.Tokenizer.from_file(sequence_files.TOKENIZER)
    want, at = [], 0
    for d, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append(key(d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    rows = run(spark, "op7_sequence_files", folder)
    assert sorted(key(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == sorted(want)


def test_sequences_are_of_equal_length(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 700)) for i in range(12)] + [(99, "")], "doc_id long, text string")
    files = sequence_files.write_sequences(docs, str(tmp_path / "s"), length=8, partitions=3).orderBy("part").collect()
    ids = []
    for f in files:
        reader = sequence_files.open_sequences(f.file)
        assert str(reader.schema.field("ids").type) == "fixed_size_list<item: uint16>[8]" and reader.num_record_batches > 1
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            mask = batch.column("mask").values.to_numpy(zero_copy_only=False)
            ids += batch.column("ids").values.to_numpy()[mask].tolist()
    encode = sequence_files.Tokenizer.from_file(sequence_files.TOKENIZER).encode
    assert ids == [i for r in sorted(docs.collect()) for i in [*encode(r.text, add_special_tokens=False).ids, 0]]


def buffers(texts):
    return text_buffers(pa.array(texts))


@pytest.mark.parametrize("text", ["a  b", " a b ", "\n x y\n\nz ", "it's 12 34's ! ?? é b \x1c c d", " ", "a ", "a\t b", "tab\tb c", "<|endoftext|> a b", "\x85 a\xa0b c", "a \xa0 b", "a\u2003 b \u3000 c", "x \u2028", "é è à", "\x1c a \x1d b"])
def test_parts_encode_like_whole_texts(text):
    encode = sequence_files.Encoder(sequence_files.TOKENIZER)
    want = encode.tokenizer.encode(text, add_special_tokens=False).ids
    ids, stops = encode(*buffers([text, "", text]))
    assert ids.tolist() == [*want, 0, 0, *want, 0] and stops.tolist() == [len(want) + 1, len(want) + 2, 2 * len(want) + 3]


def thue_morse(letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(1024))


def test_parts_with_one_hash_keep_their_ids(monkeypatch):
    a, b = thue_morse("ab"), thue_morse("ba")
    texts = [f"start {a} {b} end", "", f"{b} {a}", "x" * 300_000 + " y", " ".join(prose(k, 40) for k in range(9)), "é a", ""]
    for same in (False, True):  # with the hashes as they are, and with one hash for all parts
        if same:
            monkeypatch.setattr(sequence_files, "hash_runs", lambda data, starts: np.full(len(starts), 7, np.uint64))
        encode = sequence_files.Encoder(sequence_files.TOKENIZER)
        want = [i for t in texts for i in [*encode.tokenizer.encode(t, add_special_tokens=False).ids, 0]]
        for _ in range(2):
            assert encode(*buffers(texts))[0].tolist() == want


def test_words_made_to_collide_have_different_hashes():
    words = [thue_morse("ab"), thue_morse("ba"), thue_morse("xy"), thue_morse("yx"), "ab", "ba", "a", "b", "aa", "a\0"]
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    starts = np.cumsum([0, *map(len, words)])[:-1]
    assert len(set(hash_runs(raw, starts).tolist())) == len(words)
    data, offsets = buffers([" ".join(words[:8])])
    assert len(set(hash_words(data, offsets)[1].tolist())) == 8


def test_parts_are_forgotten(monkeypatch):
    monkeypatch.setattr(sequence_files, "REMEMBERED", 40)
    encode = sequence_files.Encoder(sequence_files.TOKENIZER)
    texts = [prose(k, 30) for k in range(60)]
    for k in range(0, 60, 3):
        want = [i for t in texts[k : k + 3] for i in [*encode.tokenizer.encode(t, add_special_tokens=False).ids, 0]]
        assert encode(*buffers(texts[k : k + 3]))[0].tolist() == want
    assert len(encode.hashes) < 200


def plain_fingerprint(text):
    words = solid(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, folder):
    rows = [(d, plain_fingerprint(t)) for d, t, _ in ROWS]
    label = {f: f for _, f in rows}
    for _ in rows:
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for d, f in rows:
        if d is not None:
            least[label[f]] = min(d, least.get(label[f], d))
    want = sorted(key(d, f"{f:016x}", least[label[f]] if label[f] in least else None) for d, f in rows)
    assert sorted(key(*r) for r in run(spark, "op8_simhash", folder)) == want


@pytest.mark.parametrize("distance", [4, 7])
def test_links_connect_whatever_is_near(spark, distance):
    """A dense ball, chains and random fingerprints: the same components as all pairs."""
    draw = np.random.Generator(np.random.PCG64(distance))
    centre = int(draw.integers(0, 1 << 63))
    fps = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 63, (800, 2))} | set(map(int, draw.integers(0, 1 << 63, 300)))
    at = int(draw.integers(0, 1 << 63))
    for k in range(0, 60, distance):  # each differs from the next in `distance` bits
        at ^= sum(1 << b for b in range(k, min(63, k + distance)))
        fps.add(at)
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    array = np.array(fps, np.uint64)
    for k, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(array[k + 1 :] ^ np.uint64(f)) <= distance):
            a, b = root(f), root(fps[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    lineage = simhash.Lineage(spark)
    nodes = lineage.cut(spark.createDataFrame([(f, f) for f in fps], "fp long, least long"))
    assert simhash.links(nodes, distance).count() < 40 * len(fps)
    got = {r.fp: r.component_id for r in simhash.node_classes(lineage, nodes, distance).collect()}
    assert got == {f: root(f) for f in fps}


def test_sharding(spark, folder):
    rows = run(spark, "op9_sharding", folder)
    assert sorted(key(r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        key(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in ROWS)
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    where = {}
    for r in rows:
        where.setdefault((r.text_crc32, r.size) if r.size > 1 else 0, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("heavy", [0, 1_000_000, 8_000_000])
def test_differencing_over_levels(spark, monkeypatch, heavy):
    """Also with a group of more than an equal share: the others are level then."""
    for name, n in (("GROUPS_PER_BUCKET", 64), ("ROOT", 512), ("HEAVY", 64), ("FINE", 64)):
        monkeypatch.setattr(sharding, name, n)
    draw = np.random.Generator(np.random.PCG64(4))
    sizes = [int(x) for x in draw.integers(1, 10_000, 4000)] + [heavy] * (heavy > 0)
    groups = spark.createDataFrame([(hashlib.sha256(b"%d" % k).digest(), s) for k, s in enumerate(sizes)], "digest binary, bytes long")
    size = {hashlib.sha256(b"%d" % k).digest(): s for k, s in enumerate(sizes)}
    rows = sharding.balance(groups, 16, sharding.Lineage(spark)).collect()
    assert len(rows) == len(sizes)
    total = Counter()
    for r in rows:
        total[r.shard] += size[bytes(r.digest)]
    sums = sorted(total[s] for s in range(16))
    if heavy * 16 > sum(sizes):
        assert sums.pop() == heavy
    assert sums[-1] - sums[0] < 0.02 * sums[-1]


def test_differencing_beats_dealing_by_size():
    draw = np.random.Generator(np.random.PCG64(2))
    sizes = draw.integers(1, 1000, 200)
    parts = np.zeros((200, 4), np.int64)
    parts[:, 0] = sizes
    place = sharding.difference(parts)[:, 0]
    sums = np.bincount(place, sizes, 4)
    greedy = np.zeros(4)
    for s in sorted(sizes, reverse=True):
        greedy[np.argmin(greedy)] += s
    assert np.ptp(sums) <= np.ptp(greedy)


def test_kneser_ney(spark, folder):
    tokens = [(d, [*solid(t), None]) for d, t, _ in ROWS]
    counts, pairs = Counter(), Counter()
    for d, words in tokens:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(words)
            pairs.update(zip(["<s>", *words], words, strict=False))
    n, v = sum(counts.values()), len(counts)
    continued = Counter(w for _, w in pairs)

    def discounts(of):
        return kneser_ney.discounts([sum(c == k for c in of.values()) for k in (1, 2, 3, 4)])

    d2, d1 = discounts(pairs), discounts(continued)
    after, spare = Counter(), Counter()
    for (u, _), c in pairs.items():
        after[u] += c
        spare[u] += d2[min(c, 3) - 1]
    floor = sum(d1[min(c, 3) - 1] for c in continued.values()) / len(pairs) / (v + 1)

    def p(u, w):
        c, k = continued[w], pairs[u, w]
        low_ = (c - d1[min(c, 3) - 1] if c else 0) / len(pairs) + floor
        return (k - d2[min(k, 3) - 1] if k else 0) / after[u] + spare[u] / after[u] * low_ if after[u] else low_

    want = []
    for d, words in tokens:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        score = sum(math.log10(p(u, w)) for u, w in zip(["<s>", *words], words, strict=False))
        held = d is not None and zlib.crc32(str(d).encode()) % 5 == 1
        want.append((key(d), held, len(words), sum(w in counts for w in words), n, round(base, 4), round(score, 4)))
    rows = run(spark, "op10_kneser_ney", folder)
    got = [(key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in rows]
    assert sorted(got) == sorted(want)
    assert sum(p("w1", w) for w in counts) + p("w1", "unseen") == pytest.approx(1)


def test_blobs_round_trip():
    draw = np.random.Generator(np.random.PCG64(3))
    keys = np.unique(draw.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    counts = draw.integers(1, 9, len(keys))
    again = kneser_ney.merge([kneser_ney.pack(keys, counts), kneser_ney.pack(keys[::3], counts[::3]), kneser_ney.pack(keys[:0], counts[:0])])
    assert (again[0] == keys).all() and again[1].sum() == counts.sum() + counts[::3].sum()


def test_counts_never_wrap():
    with pytest.raises(OverflowError):
        kneser_ney.pack(np.array([1, 2], np.uint64), np.array([1, 5_000_000_000]))
    keys, counts = kneser_ney.unpack(kneser_ney.pack(np.array([1, 2], np.uint64), np.array([7, 2**32 - 1])))
    assert keys.tolist() == [1, 2] and counts.tolist() == [7, 2**32 - 1]
