"""Benchmark decontamination by spaced-seed hashes and substitution-tolerant verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflux.llm.common import Lineage, fresh, hash_words, small_batches, text_buffers, text_slices, whole_text

#: Words that a seed spans. The ignored positions of the 13 seeds are the lines of the projective plane of order 3, so
#: any two positions are ignored together by one seed: two substitutions in a window of 13 words never hide a hit.
SPAN = 13
IGNORED = [tuple(sorted((d + s) % SPAN for d in (0, 1, 3, 9))) for s in range(SPAN)]
#: What these miss of stretches with 80 % in common (four substitutions in the midst of 20 words) these words find. Together they
#: find every stretch of 13 to 25 words, and a longer one holds one of those. Found by greedy search, tested by enumeration.
FURTHER = [(0, 1, 2, 4, 5, 7), (0, 1, 2, 6, 9, 11), (0, 1, 3, 7, 8, 9)]
#: An overlap counts from so many words, equal or not, if a differing word comes with so many equal ones: a share of 0.8.
LEAST_WORDS, EQUAL_PER_OTHER = 13, 4
#: Items with fewer words than this say too little to be searched for.
LEAST_ITEM = 5
#: Windows of the benchmark that are searched in one pass over the documents: the index of a pass has 13 hashes each.
WINDOWS_PER_PASS = 200_000
#: Bytes of texts that are searched together, if they have more than one text, and windows that are hashed at a time.
BYTES, WINDOWS_AT_ONCE = 1 << 20, 1 << 16
#: Characters of a word and what follows it, at least: for the number of passes.
CHARS_PER_WORD = 2

_POSITION = np.random.Generator(np.random.PCG64(13)).integers(1, 1 << 63, SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BITMAP_BITS = 23


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def seed_hashes(words: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each seed, its number and the hash of every window of its width without the ignored words."""
    n = len(words) - span + 1
    if n <= 0:
        return
    if span < SPAN:  # a short item is looked for whole
        for number, kept in enumerate(short_seeds(span)):
            yield number, _picked(words, kept, n, span << 16 | number << 8)
        return
    parts = [words[p : p + n] * _POSITION[p] for p in range(span)]
    total = parts[0].copy()
    for part in parts[1:]:
        total += part
    for number, ignored in enumerate(IGNORED):
        yield number, _mixed(total - parts[ignored[0]] - parts[ignored[1]] - parts[ignored[2]] - parts[ignored[3]] + np.uint64(number << 8))
    for number, kept in enumerate(FURTHER, len(IGNORED)):
        yield number, _picked(words, kept, len(words) - kept[-1], number << 8)


def _picked(words: np.ndarray, kept: tuple[int, ...], n: int, salt: int) -> np.ndarray:
    total = np.full(n, salt, np.uint64)
    for p in kept:
        total += words[p : p + n] * _POSITION[p]
    return _mixed(total)


def short_seeds(span: int) -> list[tuple[int, ...]]:
    """The words that the seeds of an item of ``span`` words, under 13, look at: some seed ignores all that may differ."""
    if span < 10:  # one word may differ
        step = max(1, span - 5)
        ignored = [range(low, low + step) for low in range(0, span, step)]
    else:  # two may
        ignored = IGNORED
    return [tuple(p for p in range(span) if p not in some) for some in ignored]


def seed_width(number: int, span: int) -> int:
    """Words from the first to the last that a seed may look at."""
    return span if span < SPAN or number < len(IGNORED) else FURTHER[number - len(IGNORED)][-1] + 1


class Index:
    """Seed hashes of a block of benchmark items, and the words of the items."""

    def __init__(self, items: list[tuple]):
        texts = [np.frombuffer((text or "").encode(), np.uint8) for _, text in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        starts, hashes = hash_words(np.concatenate([*texts, np.zeros(0, np.uint8)]), offsets)
        cuts = np.searchsorted(starts, offsets)
        self.ids = [i for i, _ in items]
        self.words = [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        keys, owners, places, spans = [], [], [], set()
        for k, words in enumerate(self.words):
            if len(words) < LEAST_ITEM:
                continue
            span = min(SPAN, len(words))
            spans.add(span)
            for _, h in seed_hashes(words, span):
                keys.append(h)
                owners.append(np.full(len(h), k))
                places.append(np.arange(len(h)))
        none = np.zeros(0, np.int64)
        key = np.concatenate(keys) if keys else none.astype(np.uint64)
        turn = np.argsort(key, kind="stable")
        self.key = key[turn]
        self.owner = np.concatenate([none, *owners])[turn]
        self.place = np.concatenate([none, *places])[turn]
        self.spans = sorted(spans)
        self.bitmap = np.zeros(1 << _BITMAP_BITS, bool)
        self.bitmap[self.key >> np.uint64(64 - _BITMAP_BITS)] = True

    def hits(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal) of the hash hits of a run of documents' words; a window does not cross ``ends``."""
        found = []
        for span in self.spans:
            for low in range(0, max(0, len(words) - span + 1), WINDOWS_AT_ONCE):
                for number, h in seed_hashes(words[low : low + WINDOWS_AT_ONCE + span - 1], span):
                    at = np.flatnonzero(self.bitmap[h >> np.uint64(64 - _BITMAP_BITS)])
                    if len(at):
                        found.append(self._matches(h[at], at + low, seed_width(number, span), ends))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def _matches(self, hashes: np.ndarray, at: np.ndarray, span: int, ends: np.ndarray) -> np.ndarray:
        """(document, item, diagonal) of windows at ``at`` whose hashes are in the index."""
        left = np.searchsorted(self.key, hashes)
        counts = np.searchsorted(self.key, hashes, side="right") - left
        document = np.searchsorted(ends, at, side="right")
        # A window must end within its document.
        here = np.flatnonzero((counts > 0) & (document == np.searchsorted(ends, at + span - 1, side="right")))
        at, left, counts, document = at[here], left[here], counts[here], document[here]
        before = np.cumsum(counts) - counts
        entry = np.repeat(left - before, counts) + np.arange(counts.sum())
        return np.stack([np.repeat(document, counts), self.owner[entry], np.repeat(at, counts) - self.place[entry]], axis=1)


def best_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, stop, equal words) of the longest stretch with 80 % equal words, the first of several.

    An equal word earns 1 and a differing one costs 4; a stretch counts if its sum
    is not negative. For each end the first start with a sum as low is looked up.
    """
    run = np.concatenate([[0], np.cumsum(np.where(equal, 1, -EQUAL_PER_OTHER))])
    first = np.searchsorted(-np.minimum.accumulate(run), -run)
    stop = int(np.argmax(np.arange(len(run)) - first))
    start = int(first[stop])
    return start, stop, int(equal[start:stop].sum())


def _search(index: Index, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """(row, item, start, stop, place in the item, words in common) of the overlaps in a batch of texts, the best of each row and item."""
    for low, some, marks in text_slices(data, offsets, BYTES):
        for row, *found in _search_slice(index, some, marks):
            yield low + row, *found


def _search_slice(index: Index, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    starts, hashes = hash_words(data, offsets)
    cuts = np.searchsorted(starts, offsets)
    ends = cuts[1:]
    best: dict[tuple[int, int], tuple] = {}
    for row, item, diagonal in index.hits(hashes, ends).tolist():
        words = index.words[item]
        low, high = max(cuts[row], diagonal), min(cuts[row + 1], diagonal + len(words))
        equal = hashes[low:high] == words[low - diagonal : high - diagonal]
        start, stop, common = best_overlap(equal)
        if stop - start < min(LEAST_WORDS, len(words)):
            continue
        entry = (common, -(low + start), low + start - cuts[row], low + stop - cuts[row], low + start - diagonal)
        best[row, item] = max(best.get((row, item), entry), entry)
    for (row, item), (common, _, start, stop, from_item) in best.items():
        yield row, item, int(start), int(stop), int(from_item), common


def overlaps(spark: SparkSession, rows: DataFrame, benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """Overlaps of the texts of ``rows`` (keys..., text) with benchmark items (item_id, text).

    Words are runs of letters, digits and characters beyond ASCII of the
    lower-cased texts. Windows that agree in all positions of a seed are
    hits; around a hit the words are compared along the diagonal, and a stretch
    of at least 13 words (the whole item, if shorter) with 80 % of the words in
    common is an overlap, wherever in it the others are. Seeds miss no such
    stretch. Items under five words are not searched for. Null
    texts count as empty and overlap nothing; repeated rows and items are
    reported each; empty tables give an empty result.

    The benchmark is searched in passes of a bounded number of windows: a pass
    broadcasts its index and reads all documents.

    Columns: keys, item_id, doc_start, doc_stop, item_start (words), common,
    item_words, coverage (words in common of the item's words).
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"{kinds}, item_id {item_kind}, doc_start int, doc_stop int, item_start int, common int, item_words int, coverage double"
    narrow = rows.select(*keys, F.lower(whole_text()).alias("text"))
    found = None
    for index in _indexes(spark, benchmark):
        one = narrow.mapInArrow(_reader(index, keys, schema), schema)
        found = one if found is None else found.unionByName(one)
    return found


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item, as ``overlaps`` finds them; all columns go through."""
    schema = docs.schema
    name = fresh(docs.columns, "searched")
    for index in _indexes(spark, benchmark):
        docs = docs.withColumn(name, F.lower(whole_text(text))).mapInArrow(_sieve(index), schema)
    return docs


def _indexes(spark: SparkSession, benchmark: DataFrame) -> Iterator[Broadcast]:
    """Indexes of the benchmark, each of a bounded number of windows; its items reach the driver one index at a time."""
    small_batches(spark)
    lineage = Lineage(spark)
    sized = lineage.cut(benchmark.select("item_id", F.lower(whole_text()).alias("text")))
    passes = int((sized.agg(F.sum(F.length("text"))).first()[0] or 0) / CHARS_PER_WORD // WINDOWS_PER_PASS) + 1
    sized = sized.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    for k in range(passes):
        items = [(r.item_id, r.text) for r in sized.where(F.col("pass") == k).orderBy("item_id", "text").toLocalIterator()]
        yield spark.sparkContext.broadcast(Index(items))
    lineage.release()


def _sieve(index: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            kept[[row for row, *_ in _search(table, *text_buffers(batch.columns[-1]))]] = False
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(kept))

    return run


def _reader(index: Broadcast, keys: list[str], schema: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(len(keys)))
            hits = list(_search(table, data, offsets))
            if not hits:
                continue
            row, item, start, stop, from_item, common = (list(x) for x in zip(*hits, strict=True))
            n_words = [len(table.words[i]) for i in item]
            columns = [batch.column(c).take(pa.array(row)) for c in range(len(keys))]
            whole = [pa.array(x, pa.int32()) for x in (start, stop, from_item, common, n_words)]
            share = pa.array([c / n for c, n in zip(common, n_words, strict=True)], pa.float64())
            ids = pa.array([table.ids[i] for i in item])
            names = [*keys, "item_id", "doc_start", "doc_stop", "item_start", "common", "item_words", "coverage"]
            yield pa.RecordBatch.from_arrays([*columns, ids, *whole, share], names=names)

    return read


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item it contains a passage of."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = overlaps(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return found.withColumn("contaminated", F.lit(True))
