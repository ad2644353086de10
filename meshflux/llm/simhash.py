"""Near-duplicates by SimHash: one-wildcard segment variants, equality of variants, verification of the distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflux.llm import minhash, similar
from meshflux.llm.common import Lineage, attach, keyed, quoted, shuffle_partitions, small_batches, text_buffers, whole_text
from meshflux.llm.linking import components

BITS = 64
SEED = 42
#: Shingle hashes that are unpacked into bits at a time.
_BLOCK = 1 << 14
#: Members of one bucket that are compared at fixed steps, and in one matrix; more are traversed.
_SMALL, _MEDIUM = 16, 512
#: Bands of so many minima that find the similar texts of ``keep_one`` whose fingerprints differ in more bits: at a
#: Jaccard similarity of 0.8 all bands miss a pair with a chance of (1 - 0.8 ** 5) ** 32 = 3e-6, above it with less.
_MINIMA, _BANDS = 5, 32


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words of a lower-cased text, repeats included; of the whole text if it has fewer."""
    words = text.split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = max(0, len(words) - shingle)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: last + 1].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), "<u8", last + 1)


def fingerprint(text: bytes, shingle: int) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; zero without words."""
    return hashes_fingerprint(shingle_hashes(text, shingle))


def hashes_fingerprint(hashes: np.ndarray) -> int:
    return majority(bit_counts(hashes), len(hashes))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        block = hashes[k : k + _BLOCK]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return counts


def majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(rows: DataFrame, key: str, text: str, shingle: int = 4) -> DataFrame:
    """(key, fp) of every row; key and text are columns, a null text is empty."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, marks = text_buffers(batch.column(1))
            found = [fingerprint(data[a:b].tobytes().lower(), shingle) for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[key, "fp"])

    narrow = rows.select(key, whole_text(text).alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    return narrow.mapInArrow(score, f"{key} {kind}, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of as few segments as leave one with at most one differing bit."""
    n = distance // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fp: Column, distance: int) -> Column:
    """All one-wildcard variants of all segments, 64 keys: the place of the deleted bit, then the segment without it."""
    keys = []
    for shift, width in segments(distance):
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        for p in range(width):
            keys.append(value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << p))).bitwiseOR(F.lit((shift + p) << 56)) if width <= 56 else F.hash(value))
    return F.array(*keys)


def _bucket_links(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a bucket that connect exactly what all its links connect.

    A traversal: whatever is near the vertex at hand is linked to it and leaves
    the open set, so a dense group costs about one comparison a member.
    """
    waiting = fps
    while len(waiting) > 1:
        frontier, waiting = [waiting[0]], waiting[1:]
        while frontier and len(waiting):
            vertex = frontier.pop()
            near = np.bitwise_count(waiting ^ vertex) <= distance
            if near.any():
                reached = waiting[near]
                yield np.full(len(reached), vertex), reached
                frontier.extend(reached)
                waiting = waiting[~near]


def _links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in a run of whole buckets, sorted by key."""
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(heads, len(keys)))
    left, right = [], []
    few = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
    k, v = keys[few], fps[few]
    for step in range(1, _SMALL):
        if len(k) <= step:
            break
        near = (k[step:] == k[:-step]) & (np.bitwise_count(v[step:] ^ v[:-step]) <= distance)
        left.append(v[:-step][near])
        right.append(v[step:][near])
    for h, n in zip(heads[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        members = fps[h : h + n]
        if n <= _MEDIUM:
            a, b = np.nonzero(np.triu(np.bitwise_count(members[:, None] ^ members) <= distance, 1))
            if len(a) <= 2 * n:
                left.append(members[a])
                right.append(members[b])
                continue
        for a, b in _bucket_links(members, distance):
            left.append(a)
            right.append(b)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect whatever differs in at most ``distance`` bits.

    Two fingerprints within the distance agree in a variant of some segment, so
    they meet in its bucket; there the distance is verified. A bucket yields a
    spanning set of its links, never all pairs of a dense group. Rows are 16
    bytes and buckets are read one after the other.
    """
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v = [], []

        def flush(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            a, b = (x.view(np.int64) for x in _links(k, v, distance))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            k, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            v = v.view(np.uint64)  # bitwise_count takes the magnitude of signed numbers
            if not len(k):
                continue
            done = int(np.searchsorted(k, k[-1]))  # the last bucket may go on in the next batch
            if done or (held_k and held_k[-1][-1] != k[-1]):
                yield flush(np.concatenate([*held_k, k[:done]]), np.concatenate([*held_v, v[:done]]))
                held_k, held_v = [], []
            held_k.append(k[done:])
            held_v.append(v[done:])
        if held_k:
            yield flush(np.concatenate(held_k), np.concatenate(held_v))

    keyed = nodes.select(F.explode(variants(F.col("fp"), distance)).alias("key"), "fp")
    dealt = keyed.repartition(shuffle_partitions(nodes.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def classes(spark: SparkSession, rows: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``rows`` (doc_id, text).

    Fingerprints link at ``distance`` or fewer differing bits; component_id is
    the smallest doc_id that can be reached, the row itself included. Rows with
    equal fingerprints are one node. Null texts count as empty, texts without
    words have fingerprint zero and link like others; a null doc_id is in the
    result and never the smallest, unless all are null. Other columns are
    ignored and an empty table gives an empty result.
    """
    lineage = Lineage(spark)
    found = lineage.cut(fingerprints(rows, "doc_id", "text", shingle))
    nodes = lineage.cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return found.join(node_classes(lineage, nodes, distance), "fp")


def node_classes(lineage: Lineage, nodes: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id) of distinct fingerprints (fp, least), a cut table that is dropped."""
    linked = lineage.cut(links(nodes, distance))
    roots = components(lineage, linked)
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = lineage.cut(rooted)
    for table in (linked, roots, nodes):
        lineage.drop(table)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = 5, distance: int = 4, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest doc_id (null last), of repeated rows any one.

    Texts that agree in their words (A-Z lower-cased) are one node. Candidates
    are nodes whose fingerprints are equal or linked, through others too, and
    nodes with a band of minima in common, which finds what the distance misses;
    a candidate counts if the sets of ``shingle``-word runs have a Jaccard
    similarity of ``percent`` or more, so no text is dropped for its
    fingerprint or bands alone. Texts without words, null ones too, are one
    node. Texts of any length are split a megabyte at a time. All
    columns go through; an empty table gives an empty result.
    """
    small_batches(spark)
    lineage = Lineage(spark)
    rows, key = keyed(docs)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, marks = text_buffers(batch.column(2))
            found = []
            for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                digest, parts, counts, n = hashlib.blake2b(digest_size=16), [], np.zeros(BITS, np.int64), 0
                for part in minhash.runs(data[a:b].tobytes().lower(), shingle, digest):
                    parts.append(np.unique(part))
                    counts += bit_counts(part)
                    n += len(part)
                hashes = minhash.distinct(parts)
                places = minhash.signature(hashes, _MINIMA * _BANDS)
                bands = minhash.bands(places, _MINIMA) if n else []
                found.append((digest.digest(), len(hashes), bands, similar.sketch(places, hashes), majority(counts, n)))
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["row", "doc_id", "words", "size", "bands", "sketch", "fp"])

    narrow = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = lineage.cut(narrow.mapInArrow(describe, "row string, doc_id long, words binary, size long, bands array<long>, sketch array<long>, fp long"))
    nodes = minhash.numbered(lineage, found, "fp")
    near = components(lineage, lineage.cut(links(nodes.select("fp").distinct(), distance))).select(F.col("node").alias("fp"), F.col("root").alias("class"))
    alike = nodes.select("fp", "node").join(near, "fp", "left").select(F.xxhash64(F.lit("class"), F.coalesce("class", "fp")).alias("bucket"), "node")
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node").union(alike)
    roots = minhash.linked(lineage, nodes, buckets, narrow.select("row", "text"), percent, _MINIMA * _BANDS, shingle)
    placed = nodes.select("node", "first").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    dropped = lineage.cut(found.select("row").join(kept, "row", "left_anti"))
    lineage.release(dropped)
    return attach(rows, dropped.withColumnRenamed("row", key), [key], "left_anti").select(*quoted(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
