"""Token sequences of equal length in Arrow files: fixed-size lists for random access without copies."""

from __future__ import annotations

import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshflux.llm.common import Lineage, attach, byte_class, file_system, hash_runs, new_folder, shuffle_partitions, text_buffers, text_slices, whole_text

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The identifier appended to each document. Texts hold it too, so the mask tells where documents end.
END = 0
LENGTH = 2048
#: Sequences of a record batch.
SEQUENCES = 512
#: Parts of texts whose identifiers a worker remembers; of more, the half that recurs most stays.
REMEMBERED = 1_000_000
#: Bytes of parts that are compared with remembered ones at a time.
COMPARED = 1 << 18
#: Bytes of texts that are encoded together, if they have more than one text.
BYTES = 1 << 21

#: Bytes of white space below 128. Others end in two or three bytes, matched by the pattern.
_SPACES = byte_class(bytes([*range(9, 14), *range(28, 33)]), False)
_WIDE_SPACES = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def cut_points(data: np.ndarray, offsets: np.ndarray, whole: list[bytes]) -> np.ndarray:
    """Where the parts of texts start: texts, and single spaces between characters that are not white space.

    Such a space starts a new piece of the pre-tokeniser in any context, so the
    parts can be encoded one by one. Texts with a string of ``whole`` stay whole.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        inner = data[1:-1] == 32
        inner &= ~_SPACES[data[:-2]]
        inner &= ~_SPACES[data[2:]]
        cut[1 : n - 1] = inner
    cut[offsets] = False
    cut[np.maximum(0, offsets[1:] - 1)] = False  # a space at the end of a text, before another text
    body = None
    if (data == 0xC2).any() or ((data >= 0xE1) & (data <= 0xE3)).any():
        body = data.tobytes()
        for match in _WIDE_SPACES.finditer(body):
            cut[max(0, match.start() - 1)] = cut[match.end()] = False
    for string in whole:
        body = data.tobytes() if body is None else body
        at = body.find(string)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, side="right")) - 1
            cut[offsets[k] : offsets[k + 1]] = False
            at = body.find(string, int(offsets[k + 1]))
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut[:n])


class _Grown:
    """An array that is appended to; its room doubles."""

    def __init__(self, kind: np.dtype | type):
        self.room, self.size = np.empty(1 << 10, kind), 0

    def __len__(self) -> int:
        return self.size

    def append(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.room):
            room = np.empty(1 << size.bit_length(), self.room.dtype)
            room[: self.size] = self.all
            self.room = room
        self.room[self.size : size] = values
        self.size = size

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


class Encoder:
    """Identifiers of whole texts, with the parts that recur encoded once.

    A part is looked up by its 64-bit hash, in a table with open addressing, and
    its bytes are compared with those of the part found. A part whose hash
    belongs to other bytes is encoded by itself each time.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.token = _token_type(self.tokenizer)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.slots = 1 << (4 * REMEMBERED - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.places = np.zeros(self.slots, np.int32)
        self.hashes = _Grown(np.uint64)
        # The identifiers and the bytes of all known parts, end to end, where each starts, and how long it is.
        self.ids, self.bytes = _Grown(self.token), _Grown(np.uint8)
        self.starts, self.sizes, self.heads, self.lengths, self.uses = (_Grown(np.int64) for _ in range(5))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 of unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        mask = np.uint64(self.slots - 1)
        left, slot = np.arange(len(hashes)), hashes & mask
        while len(left):
            key = self.keys[slot]
            here = key == hashes[left]
            out[left[here]] = self.places[slot[here]]
            go = ~here & (key != 0)
            left, slot = left[go], (slot[go] + np.uint64(1)) & mask
        return out

    def _add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, lengths: np.ndarray, uses: np.ndarray) -> None:
        """Parts whose hashes are not known yet, each once."""
        mask = np.uint64(self.slots - 1)
        left, slot = np.arange(len(hashes)), hashes & mask
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]  # of several for one slot the last stays
            done = free & (self.keys[slot] == hashes[left])
            self.places[slot[done]] = len(self.hashes) + left[done]
            left, slot = left[~done], (slot[~done] + np.uint64(1)) & mask
        self.starts.append(len(self.ids) + np.cumsum(sizes) - sizes)
        self.heads.append(len(self.bytes) + np.cumsum(lengths) - lengths)
        for column, values in ((self.sizes, sizes), (self.lengths, lengths), (self.uses, uses), (self.ids, ids), (self.bytes, data), (self.hashes, hashes)):
            column.append(values)

    def _forget(self) -> None:
        """Keep the parts used most, up to half of what may be remembered."""
        kept = np.argsort(-self.uses.all, kind="stable")[: REMEMBERED // 2]
        sizes, lengths, uses = self.sizes.all[kept], self.lengths.all[kept], self.uses.all[kept]
        ids = self.ids.all[_spread(self.starts.all[kept], sizes)]
        data = self.bytes.all[_spread(self.heads.all[kept], lengths)]
        hashes = self.hashes.all[kept]
        self._clear()
        self._add(hashes, ids, sizes, data, lengths, uses // 2)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = []
        for k in range(0, len(texts), 4096):
            lists += [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), self.token, int(sizes.sum())), sizes

    def _others(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which parts have other bytes than those remembered at their places."""
        other = self.lengths.all[places] != lengths
        stops = begins + lengths
        low = 0
        while low < len(begins):
            high = max(low + 1, int(np.searchsorted(stops, begins[low] + COMPARED, side="right")))
            some = low + np.flatnonzero(~other[low:high])
            if len(some) == 1:  # perhaps a long part
                head, n = int(self.heads.all[places[some[0]]]), int(lengths[some[0]])
                other[some] = not np.array_equal(data[begins[some[0]] : stops[some[0]]], self.bytes.all[head : head + n])
            elif len(some):
                own = data[begins[low] : stops[high - 1]] if len(some) == high - low else data[_spread(begins[some], lengths[some])]
                differs = own != self.bytes.all[_spread(self.heads.all[places[some]], lengths[some])]
                if differs.any():
                    other[some] = np.logical_or.reduceat(differs, np.cumsum(lengths[some]) - lengths[some])
            low = high
        return np.flatnonzero(other)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of the texts end to end, each with the end identifier, and where each stops."""
        if len(self.hashes) > REMEMBERED:
            self._forget()
        begins = cut_points(data, offsets, self.added)
        lengths = np.diff(np.append(begins, len(data)))
        texts = lambda some: [data[a : a + n].tobytes().decode() for a, n in zip(begins[some].tolist(), lengths[some].tolist(), strict=True)]
        hashes = np.maximum(hash_runs(data, begins), np.uint64(1))  # zero marks a free slot
        places = self._find(hashes)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            fresh, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            self._add(fresh, *self._encode(texts(first)), data[_spread(begins[first], lengths[first])], lengths[first], np.zeros(len(fresh), np.int64))
            places[missing] = self._find(hashes[missing])
        self.uses.all[:] += np.bincount(places, minlength=len(self.uses))
        starts, sizes, pool = self.starts.all[places], self.sizes.all[places], self.ids.all
        other = self._others(data, begins, lengths, places)
        if len(other):
            own, sizes[other] = self._encode(texts(other))
            starts[other] = len(pool) + np.cumsum(sizes[other]) - sizes[other]
            pool = np.append(pool, own)
        flat = pool[_spread(starts, sizes)]
        # Identifiers before the end of each text, and room for an end identifier after them.
        ahead = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begins, offsets[1:])]
        ends = ahead + np.arange(len(ahead))
        out = np.empty(len(flat) + len(ends), self.token)
        own = np.ones(len(out), bool)
        own[ends] = False
        out[own], out[ends] = flat, END
        return out, ends + 1


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts``, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker, so that tasks share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _token_type(tokenizer: Tokenizer) -> np.dtype:
    return np.dtype("<u2") if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")


def _sequences(ids: np.ndarray, ends: np.ndarray, docs: pa.Array, length: int, valid: int, ids_type: pa.DataType) -> pa.RecordBatch:
    """A record batch of whole sequences. docs: the doc_id of each document that ends in them, in order."""
    n = len(ids) // length
    flags = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), length)
    present = np.arange(len(ids)) < valid
    ending = ends.reshape(n, length).sum(1)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ending)]), pa.int32()), docs)
    tokens = pa.FixedSizeListArray.from_arrays(pa.array(ids, ids_type), length)
    return pa.RecordBatch.from_arrays([tokens, flags(present), flags(ends), lists], names=["ids", "mask", "ends", "docs"])


def write_sequences(rows: DataFrame, folder: str, tokenizer: str = TOKENIZER, length: int = LENGTH, partitions: int | None = None) -> DataFrame:
    """Write the texts of ``rows`` (doc_id, text) in ascending doc_id order as Arrow files below ``folder``.

    Rows are dealt into ranges of doc_id; a range is a file. Its documents, each
    with the end identifier, run on through sequences of ``length``; the last
    sequence is filled up. Columns: ids (fixed-size list), mask (which ids are
    there), ends (which end a document), docs (doc_ids of the documents that end
    in the sequence). A file appears under its name only when it is whole.

    Returns (file, first, n_ids) of every file.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    n = partitions or shuffle_partitions(rows.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        token = encode.token
        ids_type = pa.from_numpy_dtype(token)
        part = TaskContext.get().partitionId()
        name = f"{folder}/{part:06d}.arrow"
        system, path = file_system(name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        whole = length * SEQUENCES
        held, held_ends, docs, size, total, sink, writer = [], [], [], 0, 0, None, None

        def flush(last: bool) -> None:
            nonlocal held, held_ends, docs, size
            ids, ends = np.concatenate(held), np.concatenate(held_ends)
            cut = len(ids) if last else len(ids) // whole * whole
            for k in range(0, cut, whole):
                some, marks = ids[k : min(k + whole, cut)], ends[k : min(k + whole, cut)]
                valid, fill = len(some), -len(some) % length
                done = int(marks.sum())
                owners = pa.array(docs[:done], doc_type)
                docs = docs[done:]
                writer.write_batch(_sequences(np.append(some, np.zeros(fill, token)), np.append(marks, np.zeros(fill, bool)), owners, length, valid, ids_type))
            held, held_ends, size = [ids[cut:]], [ends[cut:]], len(ids) - cut

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for k, data, offsets in text_slices(*text_buffers(batch.column(1)), BYTES):
                ids, stops = encode(data, offsets)
                marks = np.zeros(len(ids), bool)
                marks[stops - 1] = True
                held.append(ids)
                held_ends.append(marks)
                docs += batch.column(0).slice(k, len(stops)).to_pylist()
                size += len(ids)
                total += len(ids)
                if writer is None:
                    lists = {"ids": pa.list_(ids_type, length), "mask": pa.list_(pa.bool_(), length), "ends": pa.list_(pa.bool_(), length), "docs": pa.list_(doc_type)}
                    sink = system.open_output_stream(draft)
                    writer = ipc.new_file(sink, pa.schema(lists))
                if size >= whole:
                    flush(False)
        if writer is not None:
            flush(True)
            writer.close()
            sink.close()
            system.move(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([total], pa.int64())], names=["file", "part", "n_ids"])

    narrow = rows.select("doc_id", whole_text().alias("text")).withColumn("doc_id", F.col("doc_id").cast(kind))
    ordered = narrow.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "file string, part long, n_ids long")


def open_sequences(name: str) -> ipc.RecordBatchFileReader:
    """The file's batches; mapped into memory if its folder is mounted."""
    system, path = file_system(name)
    return ipc.open_file(pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path))


def read_documents(files: DataFrame, doc_id: str) -> DataFrame:
    """(file, doc_id, place, n_tokens, ids_crc32) of the documents in the sequence files ``files`` (file); place counts ids from the file's start."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                reader = open_sequences(name)
                place, size, crc = 0, 0, 0  # of the document at hand; a document may run through many batches
                for k in range(reader.num_record_batches):
                    part = reader.get_batch(k)
                    ids, mask, ends = (part.column(c).values for c in ("ids", "mask", "ends"))
                    ids = ids.to_numpy()[: int(mask.true_count)].astype("<u4")
                    stops = np.flatnonzero(ends.to_numpy(zero_copy_only=False)) + 1
                    places, sizes, sums, begin = [], [], [], 0
                    for stop in stops.tolist():
                        crc = zlib.crc32(ids[begin:stop].tobytes(), crc)
                        size += stop - begin
                        places.append(place)
                        sizes.append(size)
                        sums.append(crc)
                        place, size, crc, begin = place + size, 0, 0, stop
                    crc = zlib.crc32(ids[begin:].tobytes(), crc)
                    size += len(ids) - begin
                    columns = [pa.array([name] * len(places), pa.string()), part.column("docs").values, *(pa.array(x, pa.int64()) for x in (places, sizes, sums))]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "place", "n_tokens", "ids_crc32"])

    return files.select("file").mapInArrow(read, f"file string, doc_id {doc_id}, place long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, rows: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """Write ``rows`` (doc_id, text) as sequence files and return what they hold, per document.

    A null text counts as empty: the end identifier alone. Rows that repeat a
    doc_id follow each other in the order of their texts; null doc_ids come
    first. An empty table writes no file and gives an empty result. Other
    columns are ignored.

    Columns: doc_id, start (ids of all documents before it), n_tokens (with the
    end), ids_crc32 (of the ids as little-endian 32-bit numbers), file.
    """
    lineage = Lineage(spark)
    kind = rows.schema["doc_id"].dataType.simpleString()
    files = lineage.cut(write_sequences(rows, new_folder(spark, "sequences"), tokenizer, length))
    # One row a file here.
    ahead = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = lineage.cut(files.select("file", ahead.alias("ahead")))
    found = read_documents(files.repartition(max(1, files.count())), kind)
    return attach(found, starts, ["file"]).select("doc_id", (F.col("ahead") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "file")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return round_trip(spark, docs).drop("file")
