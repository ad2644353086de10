"""An interpolated modified Kneser-Ney model: counted in Spark, kept as sorted hash arrays, memory-mapped by the tasks that score."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflux.llm.common import FOLD, SOLID, Lineage, file_system, find_sorted, hash_words, new_folder, shuffle_partitions, text_buffers, text_slices, whole_text

#: Hash of the end token; words are hashed from their bytes.
END = np.uint64(0xE19D6A3B5C0F4287)
#: Tokens that a task gathers before it counts and sends them on, and that it scores at a time.
GATHERED, SCORED = 1 << 22, 1 << 19
#: A word with this share of all tokens, over the number of buckets, has its bigrams spread over all buckets.
HOT_SHARE = 0.25
#: Discounts where a corpus is too small to estimate them.
PLAIN_DISCOUNTS = (0.5, 1.0, 1.5)


# --- blobs: counted keys of one bucket in one row ---------------------------------------------------------------------


def _planes(numbers: np.ndarray) -> bytes:
    """The bytes of numbers, first bytes first: sorted differences become runs of zeros."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def counted(counts: np.ndarray) -> np.ndarray:
    """Counts as numbers of 32 bits; an error where one does not fit."""
    if len(counts) and int(counts.max()) >> 32:
        raise OverflowError("a count is beyond 32 bits")
    return counts.astype("<u4")


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts."""
    steps = np.diff(keys.astype("<u8"), prepend=np.uint64(0))
    body = len(keys).to_bytes(8, "little") + _planes(steps) + _planes(counted(counts))
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(body[:8], "little")
    steps = np.frombuffer(body, np.uint8, 8 * n, 8).reshape(8, n).T.copy().view("<u8").ravel()
    counts = np.frombuffer(body, np.uint8, 4 * n, 8 + 8 * n).reshape(4, n).T.copy().view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64), counts


def merge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the counts of equal keys over blobs."""
    parts = [unpack(b) for b in blobs]
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    turn = np.argsort(keys, kind="stable")
    keys, counts = keys[turn], counts[turn].astype(np.int64)
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _by_part(parts: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A blob for each part; ``keys`` are sorted, and stay so inside a part."""
    turn = np.argsort(parts, kind="stable")
    parts, keys, counts = parts[turn], keys[turn], counts[turn]
    heads = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
    for low, high in zip(heads, [*heads[1:], len(parts)], strict=True):
        yield int(parts[low]), pack(keys[low:high], counts[low:high])


# --- arrays in the shared folder --------------------------------------------------------------------------------------


def _name(folder: str, kind: str, bucket: int) -> str:
    return f"{folder}/{kind}-{bucket:06d}.bin"


def _write(folder: str, kind: str, bucket: int, values: np.ndarray) -> None:
    """A file appears under its name only when it is whole, so a repeated task replaces it."""
    system, path = file_system(_name(folder, kind, bucket))
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    system.move(draft, path)


class Arrays:
    """Arrays of a model folder, mapped into memory once a worker. From a folder that is not mounted, the array at hand is read."""

    def __init__(self, folder: str):
        self.folder = folder
        self.open: dict[tuple[str, int], np.ndarray] = {}

    def __call__(self, kind: str, bucket: int, dtype: str) -> np.ndarray:
        if (kind, bucket) in self.open:
            return self.open[kind, bucket]
        system, path = file_system(_name(self.folder, kind, bucket))
        if not isinstance(system, fs.LocalFileSystem):
            with system.open_input_file(path) as file:
                return np.frombuffer(file.read(), dtype)
        found = self.open[kind, bucket] = np.memmap(path, dtype, "r")
        return found


_ARRAYS: dict[str, Arrays] = {}


def arrays(folder: str) -> Arrays:
    if folder not in _ARRAYS:
        _ARRAYS.clear()  # a worker serves one model at a time
        _ARRAYS[folder] = Arrays(folder)
    return _ARRAYS[folder]


# --- the model --------------------------------------------------------------------------------------------------------


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from how many types have counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return PLAIN_DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return found if all(0 < d < k + 1 for k, d in enumerate(found)) else PLAIN_DISCOUNTS


@dataclass
class Vocabulary:
    """Words by hash: bucket by the top bits, place in the sorted array of the bucket. A word's number is the place in all."""

    folder: str
    bits: int
    bases: np.ndarray  # number of the first word of each bucket, one more at the end
    tokens: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # numbers of hot words, sorted

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    @property
    def size(self) -> int:
        return int(self.bases[-1])

    def bucket_of_hash(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def bucket_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.bases, numbers, side="right") - 1, self.buckets - 1)

    def bigram_bucket(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """By the word before; of hot words, and at the start of a text, by the word itself."""
        spread = (find_sorted(self.hot, before) >= 0) | (before >= self.size)
        return np.where(spread, self.bucket_of(word), self.bucket_of(before))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes, -1 of unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        edges = np.searchsorted(self.bucket_of_hash(hashes), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            if self.bases[b + 1] > self.bases[b]:
                found = find_sorted(arrays(self.folder)("words", b, "<u8"), hashes[edges[b] : edges[b + 1]])
                out[edges[b] : edges[b + 1]] = np.where(found >= 0, found + self.bases[b], -1)
        return out

    def values(self, kind: str, dtype: str, numbers: np.ndarray) -> np.ndarray:
        """Entries of an array over words at sorted numbers; 0 at -1."""
        out = np.zeros(len(numbers), np.int64)
        edges = np.searchsorted(numbers, self.bases)
        for b in np.flatnonzero(np.diff(edges)):
            try:
                table = arrays(self.folder)(kind, b, dtype)
            except FileNotFoundError:  # nothing follows any word of the bucket
                continue
            out[edges[b] : edges[b + 1]] = table[numbers[edges[b] : edges[b + 1]] - self.bases[b]]
        return out


def _text_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, an end after each, and where each text's tokens stop."""
    starts, words = hash_words(data, offsets, SOLID, FOLD)
    counts = np.diff(np.searchsorted(starts, offsets))
    stops = np.cumsum(counts + 1)
    tokens = np.full(len(words) + len(counts), END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[stops - 1] = False
    tokens[inner] = words
    return tokens, stops


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    parts, payloads = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(payloads, pa.binary())], names=["part", "payload"])


def _count_words(texts: DataFrame, bits: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            parts = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
            return _blobs(list(_by_part(parts.astype(np.int64), keys, counts)))

        for batch in batches:
            for _, data, offsets in text_slices(*text_buffers(batch.column(0)), SCORED * 4):
                held.append(_text_tokens(data, offsets)[0])
                size += len(held[-1])
                if size >= GATHERED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(count, "part int, payload binary")


def learn_words(spark: SparkSession, texts: DataFrame, folder: str, bits: int) -> Vocabulary:
    """Exact counts of all tokens of ``texts`` (text), as sorted arrays in ``folder``."""
    def store(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["part"].iloc[0])
        keys, counts = merge(group["payload"].tolist())
        _write(folder, "words", bucket, keys.astype("<u8"))
        _write(folder, "counts", bucket, counts.astype("<u8"))
        top = np.argsort(-counts, kind="stable")[:64]
        return pd.DataFrame({"part": [bucket], "words": [len(keys)], "tokens": [int(counts.sum())], "places": [top.tolist()], "most": [counts[top].tolist()]})

    found = _count_words(texts, bits).groupBy("part").applyInPandas(store, "part int, words long, tokens long, places array<long>, most array<long>")
    rows = found.collect()  # one row a bucket
    sizes = np.zeros(1 << bits, np.int64)
    for r in rows:
        sizes[r.part] = r.words
    bases = np.concatenate([[0], np.cumsum(sizes)])
    tokens = sum(r.tokens for r in rows)
    hot = [bases[r.part] + p for r in rows for p, n in zip(r.places, r.most, strict=True) if n * (1 << bits) >= HOT_SHARE * tokens]
    return Vocabulary(folder, bits, bases, tokens, np.sort(np.array(hot, np.int64)))


@dataclass
class Model:
    words: Vocabulary
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    continuations: int  # bigram types
    word_types: tuple[int, int, int]  # words with 1, 2 and more different words before them
    hot: dict[int, tuple[int, int, int, int]]  # word -> tokens after it, types with count 1, 2 and more


def _bigrams(words: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(word before, word) as one number for each token of texts whose words are all known."""
    tokens, stops = _text_tokens(data, offsets)
    distinct, back = np.unique(tokens, return_inverse=True)
    numbers = words.numbers(distinct)[back]
    before = np.concatenate([[words.size], numbers[:-1]])
    before[stops[:-1]] = words.size
    return before.astype(np.uint64) << np.uint64(32) | numbers.astype(np.uint64)


def learn(spark: SparkSession, texts: DataFrame) -> Model:
    """Count ``texts`` (text) and store the model below the shared folder.

    Words first, then bigrams of word numbers, both combined in the tasks that
    read the texts and sent to buckets as packed arrays. Buckets follow the
    hash of a word; bigrams after a word with a large share of all tokens are
    spread over all buckets, and their sums are added up.
    """
    lineage = Lineage(spark)
    bits = max(0, (shuffle_partitions(spark) - 1).bit_length())
    folder = new_folder(spark, "kneser-ney")
    words = learn_words(spark, texts, folder, bits)
    if words.size >= 1 << 32:
        raise ValueError("more words than 32-bit numbers")
    shared = spark.sparkContext.broadcast(words)  # a number a bucket, and at most four hot words a bucket

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            parts = shared.value.bigram_bucket((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
            return _blobs(list(_by_part(parts, keys, counts)))

        for batch in batches:
            for _, data, offsets in text_slices(*text_buffers(batch.column(0)), SCORED * 4):
                held.append(_bigrams(shared.value, data, offsets))
                size += len(held[-1])
                if size >= GATHERED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def store(group: pd.DataFrame) -> pd.DataFrame:
        vocabulary = shared.value
        bucket = int(group["part"].iloc[0])
        keys, counts = merge(group["payload"].tolist())
        _write(folder, "bigrams", bucket, keys.astype("<u8"))
        _write(folder, "bigram_counts", bucket, counted(counts))
        before, after = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        context = before[heads]
        tallies = np.stack([np.add.reduceat(x.astype(np.int64), heads) for x in (counts, counts == 1, counts == 2, counts > 2)], axis=1)
        low, high = vocabulary.bases[bucket], vocabulary.bases[bucket + 1]
        spread = (find_sorted(vocabulary.hot, context) >= 0) | (context >= vocabulary.size)
        own = np.zeros((high - low, 4), "<u4")
        own[context[~spread] - low] = counted(tallies[~spread].ravel()).reshape(-1, 4)
        for k, kind in enumerate(("after", "after_1", "after_2", "after_more")):
            _write(folder, kind, bucket, own[:, k])
        rows = [("n", None, *(int((counts == k).sum()) for k in (1, 2, 3, 4)), None, None)]
        rows += [("hot", int(c), *map(int, t), None, None) for c, t in zip(context[spread], tallies[spread], strict=True)]
        continued, types = np.unique(after, return_counts=True)
        for part, blob in _by_part(vocabulary.bucket_of(continued), continued.astype(np.uint64), types):
            rows.append(("continued", None, None, None, None, None, part, blob))
        return pd.DataFrame(rows, columns=["kind", "word", "a", "b", "c", "d", "part", "payload"]).astype({c: "Int64" for c in ("word", "a", "b", "c", "d", "part")})

    sent = texts.mapInArrow(count, "part int, payload binary")
    found = lineage.cut(sent.groupBy("part").applyInPandas(store, "kind string, word long, a long, b long, c long, d long, part int, payload binary"))

    def continue_(group: pd.DataFrame) -> pd.DataFrame:
        vocabulary = shared.value
        bucket = int(group["part"].iloc[0])
        low, high = vocabulary.bases[bucket], vocabulary.bases[bucket + 1]
        numbers, types = merge(group["payload"].tolist())
        own = np.zeros(high - low, "<u4")
        own[numbers.astype(np.int64) - low] = counted(types)
        _write(folder, "continued", bucket, own)
        return pd.DataFrame([[int(types.sum()), *(int((types == k).sum()) for k in (1, 2, 3, 4)), int((types > 2).sum())]], columns=list("tabcdm"))

    def total(rows: DataFrame, columns: str) -> list[int]:
        return [int(x or 0) for x in rows.agg(*[F.sum(c).alias(c) for c in columns]).first()]

    n = total(found.where("kind = 'n'"), "abcd")
    hot = {r.word: (r.a, r.b, r.c, r.d) for r in found.where("kind = 'hot'").groupBy("word").agg(*[F.sum(x).alias(x) for x in "abcd"]).collect()}
    after = found.where("kind = 'continued'").groupBy("part").applyInPandas(continue_, "t long, a long, b long, c long, d long, m long")
    continuations, n1, n2, n3, n4, more = total(lineage.cut(after), "tabcdm")
    lineage.drop(found)
    return Model(words, discounts(n), discounts([n1, n2, n3, n4]), continuations, (n1, n2, more), hot)


class Scorer:
    """Scores of texts from the mapped arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.hot = np.sort(np.array(list(model.hot), np.int64))
        self.hot_tallies = np.array([model.hot[int(w)] for w in self.hot], np.int64).reshape(-1, 4)
        d, types, total = model.word_discounts, model.word_types, max(1, model.continuations)
        # What the word model keeps for all words alike, one unknown word included.
        spare = sum(x * y for x, y in zip(d, types, strict=True)) / total if model.continuations else 1.0
        self.floor = spare / (model.words.size + 1)

    @staticmethod
    def _less(counts: np.ndarray, by: tuple) -> np.ndarray:
        """Counts less their discounts."""
        return np.where(counts > 0, counts - np.array([0.0, *by])[np.minimum(counts, 3)], 0.0)

    def _bigram_counts(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        words = self.model.words
        keys, back = np.unique(before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), return_inverse=True)
        parts = words.bigram_bucket((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
        out = np.zeros(len(keys), np.int64)
        turn = np.argsort(parts, kind="stable")
        edges = np.searchsorted(parts[turn], np.arange(words.buckets + 1))
        get = arrays(words.folder)
        for b in np.flatnonzero(np.diff(edges)):
            at = turn[edges[b] : edges[b + 1]]
            try:
                table = get("bigrams", b, "<u8")
            except FileNotFoundError:  # no bigram fell into the bucket
                continue
            found = find_sorted(table, keys[at])
            out[at] = np.where(found >= 0, get("bigram_counts", b, "<u4")[np.maximum(found, 0)], 0)
        return out[back]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text."""
        model, words = self.model, self.model.words
        tokens, stops = _text_tokens(data, offsets)
        distinct, back = np.unique(tokens, return_inverse=True)
        numbers = words.numbers(distinct)
        known = np.flatnonzero(numbers >= 0)

        def over(kind: str, dtype: str = "<u4") -> np.ndarray:
            out = np.zeros(len(numbers), np.int64)
            out[known] = words.values(kind, dtype, numbers[known])
            return out

        counts = over("counts", "<u8")
        # The word model: how many different words stood before a word.
        low = self._less(over("continued"), model.word_discounts) / max(1, model.continuations) + self.floor
        tallies = np.stack([over(k) for k in ("after", "after_1", "after_2", "after_more")], axis=1)

        number = numbers[back]
        before = np.concatenate([[words.size], number[:-1]])
        before[stops[:-1]] = words.size
        context = np.concatenate([[0], back[:-1]])
        table = tallies[context]
        place = find_sorted(self.hot, before)
        table[place >= 0] = self.hot_tallies[place[place >= 0]]
        table[(before < 0) | ((place < 0) & (before >= words.size))] = 0

        pair = np.zeros(len(number), np.int64)
        both = np.flatnonzero((number >= 0) & (before >= 0))
        if len(both):
            pair[both] = self._bigram_counts(before[both], number[both])
        after = np.maximum(1, table[:, 0])
        spare = np.where(table[:, 0] > 0, table[:, 1:] @ np.array(model.bigram_discounts) / after, 1.0)
        log_p = np.log10(self._less(pair, model.bigram_discounts) / after + spare * low[back])
        log_base = np.log10((counts + 0.5) / (words.tokens + 0.5 * (words.size + 1)))[back]

        begins = np.concatenate([[0], stops[:-1]])
        return np.diff(stops, prepend=0), np.add.reduceat((counts > 0)[back].astype(np.int64), begins), np.add.reduceat(log_base, begins), np.add.reduceat(log_p, begins)


def score(spark: SparkSession, rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """keys, n_tokens, n_known, train_tokens, base_score, score and perplexity of every whole text of ``rows`` (keys..., text).

    A null text counts as empty: its end is its one token. A model without
    training tokens gives every token probability 1 of an empty vocabulary, so
    scores are 0. Repeated rows score alike; other columns are ignored.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for low, data, offsets in text_slices(*text_buffers(batch.column(len(keys))), SCORED * 4):
                n, known, base, total = scorer(data, offsets)
                own = [c.slice(low, len(n)) for c in batch.columns[: len(keys)]]
                train = np.full(len(n), scorer.model.words.tokens)
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (n, known, train, base, total, 10.0 ** (-total / n)))], names=names)

    narrow = rows.select(*keys, whole_text().alias("text"))
    return narrow.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id as text) mod 5 is not 1; a null doc_id is learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    model = learn(spark, docs.where(~held_out).select(whole_text().alias("text")))
    return score(spark, docs, model, ["doc_id"]).withColumn("held_out", held_out)
