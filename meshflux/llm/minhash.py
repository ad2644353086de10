"""Near-duplicates by circulant MinHash: two permutations give all coordinates, banding, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflux.llm import similar
from meshflux.llm.common import Lineage, attach, keyed, mixed, small_batches, text_buffers, whole_text

SHINGLE, PERCENT = 5, 85
#: Bands and coordinates of a band: all bands miss a pair at 0.85 with a chance of (1 - 0.85 ** 6) ** 32 = 3e-7.
BANDS, ROWS = 32, 6
_SEED = 42
#: Bytes of a text that are split into words at a time, and shingles that are shifted at a time.
_PART, _BLOCK = 1 << 20, 1 << 8
_SPACE = b" \t\n\x0b\x0c\r"


def word_parts(text: bytes, part: int = _PART) -> Iterator[list[bytes]]:
    """Words of a text, those of about ``part`` bytes at a time; a word is never cut."""
    low = 0
    while low < len(text):
        high = min(low + part, len(text))
        while high < len(text) and text[high] not in _SPACE:
            high += 1
        yield text[low:high].split()
        low = high


def runs(text: bytes, shingle: int, digest=None) -> Iterator[np.ndarray]:
    """XXH64 of all runs of ``shingle`` words of a lower-cased text, in parts; of the whole text if it has fewer. Its words go to ``digest``."""
    carried, begun = [], False
    for words in word_parts(text):
        if not words:
            continue
        if digest:
            digest.update((b" " if carried or begun else b"") + b" ".join(words))
        words = carried + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            places = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
            yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], _SEED) for a, b in places), np.uint64, len(words) - shingle + 1)
            words, begun = words[len(words) - shingle + 1 :], True
        carried = words
    if carried and not begun:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), _SEED)], np.uint64)


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> tuple[np.ndarray, bytes]:
    """Distinct hashes of the ``runs`` of a lower-cased text, in order, and a digest of its words."""
    digest = hashlib.blake2b(digest_size=16)
    return distinct([np.unique(part) for part in runs(text, shingle, digest)]), digest.digest()


def _scattered(x: np.ndarray) -> np.ndarray:
    """A permutation of the numbers of 32 bits; ``x`` is changed."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least place under the second permutation, shifted by k on a circle of 2^32 places.

    The first permutation, a mix of all 64 bits, deals the shingles over the
    circle once; the second is the same for all coordinates.
    """
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    dealt = (mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)
    for k in range(0, len(dealt), _BLOCK):
        np.minimum(least, _scattered(dealt[k : k + _BLOCK, None] + shifts).min(0), out=least)
    return least


_KEYED = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(found: np.ndarray, rows: int) -> np.ndarray:
    """A key of each band of a signature."""
    by_band = found.astype(np.uint64).reshape(-1, rows) * _KEYED[:rows]
    return mixed(mixed(by_band).sum(1, dtype=np.uint64) + np.arange(len(by_band), dtype=np.uint64) * _KEYED[-1]).view(np.int64)


def described(rows: DataFrame, key: str, n_bands: int = BANDS, band_rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, words, size, bands, sketch) of every row of ``rows`` (key, doc_id, text).

    ``words`` is a digest of its words, null without any; ``size`` counts distinct shingles.
    """
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, marks = text_buffers(batch.column(2))
            words, sizes, keys, sketches = [], [], [], []
            for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                found, digest = shingles(data[a:b].tobytes().lower(), shingle)
                places = signature(found, n_bands * band_rows)
                words.append(digest if len(found) else None)
                sizes.append(len(found))
                keys.append(bands(places, band_rows) if len(found) else [])
                sketches.append(similar.sketch(places, found))
            columns = [pa.array(words, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["row", "doc_id", "words", "size", "bands", "sketch"])

    narrow = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return narrow.mapInArrow(describe, "row string, doc_id long, words binary, size long, bands array<long>, sketch array<long>")


def sets_of(texts: DataFrame, members: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, set) of ``members`` (node, row), a cut table, from ``texts`` (row, text)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, marks = text_buffers(batch.column(1))
            found = [shingles(data[a:b].tobytes().lower(), shingle)[0].view(np.int64) for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "set"])

    return attach(texts, members, ["row"]).select("node", "text").mapInArrow(read, "node long, set array<long>")


def numbered(lineage: Lineage, found: DataFrame, *more: str) -> DataFrame:
    """Distinct texts of ``described`` rows: (node, words, first, size, bands, sketch, more...); first is the least doc_id, nulls last, and its row."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    same = [F.first(c).alias(c) for c in ("size", "bands", "sketch", *more)]
    nodes = found.where("words IS NOT NULL").groupBy("words").agg(F.min(order).alias("first"), *same)
    return lineage.cut(nodes.withColumn("node", F.monotonically_increasing_id()))


def linked(lineage: Lineage, nodes: DataFrame, buckets: DataFrame, texts: DataFrame, percent: int, bits: int, shingle: int = SHINGLE) -> DataFrame:
    """(node, root) of ``numbered`` nodes that link to another, from candidates ``buckets`` (bucket, node)."""
    def sets(members: DataFrame) -> DataFrame:
        places = lineage.cut(nodes.join(members, "node", "left_semi").select("node", F.col("first.row").alias("row")))
        return sets_of(texts, places, shingle)

    return similar.united(lineage, nodes.select("node", "size", "sketch"), buckets, sets, percent, bits)


def classes(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    A document's set has its distinct five-word shingles (A-Z lower-cased), with
    fewer words the whole sequence. Documents link at a Jaccard similarity of
    ``percent`` or more of their sets; component_id is the smallest doc_id that can be
    reached, the row itself included. Texts without words, null ones too, have
    an empty set and stay alone. Rows of equal words are one node; repeated
    doc_ids are rows of their own; a null doc_id is never the smallest unless
    all are null. Texts of any length are split a megabyte at a time. Other
    columns are ignored and an empty table gives an empty result.

    Sets are compared by 64-bit shingle hashes. Links are verified; the bands miss
    one at the threshold with a chance of 3e-7, above it with less.
    """
    small_batches(spark)
    lineage = Lineage(spark)
    rows, key = keyed(docs.select("doc_id", "text"))
    found = lineage.cut(described(rows, key))
    nodes = numbered(lineage, found)
    texts = rows.select(F.col(key).alias("row"), whole_text().alias("text"))
    roots = linked(lineage, nodes, nodes.select(F.explode("bands").alias("bucket"), "node"), texts, percent, BANDS * ROWS)
    placed = nodes.select("node", "words", "first.doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_words = lineage.cut(placed.join(least, "root").select("words", "component_id"))
    component = F.when(F.col("words").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    whole = found.join(by_words, "words", "left").select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
    return whole.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``classes`` of all documents."""
    return classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
