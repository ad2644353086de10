"""Helpers shared by the corpus operators: storage, small-side joins, vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflux.session import Lineage, shuffle_partitions


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of a table that a join may broadcast. Above it the join shuffles.
BROADCAST_ROWS = 200_000


#: Bytes of an Arrow batch that Python workers get, where the session keeps the default.
BATCH = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by BATCH bytes, so a worker's memory does not depend on the length of texts.

    A single longer text is a batch of its own. A session that sets the bound itself keeps it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(BATCH))


def whole_text(column: str = "text") -> Column:
    """The whole text, a null one as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, UPPER.lower())).otherwise(text)


def attach(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``small``, a cut table, by broadcast if it has at most ``limit`` rows and by shuffle otherwise."""
    fits = small.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(small) if fits else small, on, how)


def fresh(used: list[str], name: str) -> str:
    """``name``, lengthened until no column in ``used`` has it."""
    while name.lower() in {c.lower() for c in used}:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a string key of each row, its file and place in it, and the name of the key.

    Rows that are not read from files directly are written first, so that a
    repeated task finds the same keys.
    """
    name = fresh(docs.columns, "row_key")
    try:
        place = docs.metadataColumn("_metadata")
        found = docs.select("*", F.concat_ws(":", F.hex(F.xxhash64(place["file_path"])), place["row_index"].cast("string")).alias(name))
        found.schema  # resolves the columns
    except AnalysisException:
        return keyed(Lineage(docs.sparkSession).cut(docs))
    return found, name


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{Lineage(spark).root}/{kind}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it; a bare path is a mounted folder."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array without nulls, end to end, and where each text starts (one more at the end)."""
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    marks = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[marks[0] : marks[-1]]
    return body, marks - marks[0]


def text_slices(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: the number of the first text, bytes, offsets."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


_PIECE = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _weights(n: int) -> np.ndarray:
    """Odd weights of the places of a run, without a rule between them: powers of one base let words made for it collide."""
    return mixed(mixed(np.arange(1, n + 1, dtype=np.uint64) * _STEP)) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose every bit depends on all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_WEIGHTS = _weights(1 << 12)


def byte_class(chars: bytes, high: bool) -> np.ndarray:
    """Which byte values belong to words."""
    member = np.zeros(256, bool)
    member[list(chars)] = True
    member[128:] = high
    return member


#: Letters A-Z (folded), a-z, digits and everything beyond ASCII.
ALNUM = byte_class(UPPER.encode() + UPPER.lower().encode() + b"0123456789", True)
#: Everything but space and the control characters 9 to 13.
SOLID = ~byte_class(b" \t\n\x0b\x0c\r", False)


def fold_table(pairs: dict[int, int] | None = None) -> np.ndarray:
    """Byte to byte, with A-Z folded to a-z and ``pairs`` on top."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for a, b in (pairs or {}).items():
        table[a] = b
    return table


FOLD = fold_table()


def hash_runs(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes: from one start to the next, the last to the end."""
    global _WEIGHTS
    ends = np.append(starts[1:], len(data))
    out = np.zeros(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _PIECE, side="right")))
        sizes = ends[low:high] - starts[low:high]
        if (longest := int(sizes.max())) > len(_WEIGHTS):
            _WEIGHTS = _weights(longest)
        heads = starts[low:high] - starts[low]
        place = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
        h = np.add.reduceat(_BYTE_VALUES[data[starts[low] : ends[high - 1]]] * _WEIGHTS[place], heads)
        out[low:high] = mixed(h + sizes.astype(np.uint64))
        low = high
    return out


def hash_words(
    data: np.ndarray, offsets: np.ndarray, member: np.ndarray = ALNUM, fold: np.ndarray = FOLD
) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of the texts in ``data``.

    Works on pieces of about a megabyte that end between words, so memory stays
    bounded for any length of text; every byte of a word counts.
    """
    global _WEIGHTS
    values = _BYTE_VALUES[fold]
    starts, hashes, low, size = [], [], 0, len(data)
    while low < size:
        high = min(low + _PIECE, size)
        while high < size and member[data[high - 1]] and member[data[high]]:
            gap = np.flatnonzero(~member[data[high : high + _PIECE]])
            high = min(high + (int(gap[0]) if len(gap) else _PIECE), size)
        piece = data[low:high]
        inside = member[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        marks = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high)] - low
        first[marks] = inside[marks]
        at = np.flatnonzero(inside)
        if len(at):
            heads = np.flatnonzero(first[at])
            lengths = np.diff(np.append(heads, len(at)))
            if (longest := int(lengths.max())) > len(_WEIGHTS):
                _WEIGHTS = _weights(longest)
            place = np.arange(len(at)) - np.repeat(heads, lengths)
            h = np.add.reduceat(values[piece[at]] * _WEIGHTS[place], heads)
            starts.append(at[heads] + low)
            hashes.append(mixed(h))
        low = high
    found = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return found.astype(np.int64), np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def hash_of(words: list[str], member: np.ndarray = ALNUM, fold: np.ndarray = FOLD) -> np.ndarray:
    """Hashes of single words, as ``hash_words`` gives them."""
    out = []
    for word in words:
        raw = np.frombuffer(word.encode(), np.uint8)
        out.append(hash_words(raw, np.array([0, len(raw)]), member, fold)[1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def find_sorted(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in a sorted table, -1 where it is missing."""
    if not len(table):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return np.where(table[at] == wanted, at, -1)
