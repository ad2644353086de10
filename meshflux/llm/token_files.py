"""Flat token files without an index, and counts of their documents by a separator scan."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshflux.llm.common import Lineage, attach, file_system, new_folder, whole_text

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The identifier that ends a document; free in the vocabulary.
SEPARATOR = 50256
#: Identifiers are 16-bit, little-endian.
TOKEN = np.dtype("<u2")
#: Tokens of a block that one scan step reads.
BLOCK_TOKENS = 1 << 20


def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(rows: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the texts of ``rows`` (doc_id, text) as flat token files below ``folder``, each text followed by the separator.

    One file a partition, in the order of its rows; a file appears under its
    name only when it is whole, so a repeated task replaces it. Returns the
    manifest (file, ordinal, doc_id): which text is the how-manieth of a file.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        name = f"{folder}/{TaskContext.get().partitionId():06d}.tokens"
        system, path = file_system(name)
        draft = f"{path}.{uuid.uuid4().hex}"
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        ordinal = 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or system.open_output_stream(draft)
            for text in batch.column(1):
                ids = tokens.encode_ordinary(text.as_py())
                ids.append(SEPARATOR)
                out.write(np.array(ids, TOKEN).tobytes())
            places = pa.array(np.arange(ordinal, ordinal + batch.num_rows))
            ordinal += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), places, batch.column(0)], names=["file", "ordinal", "doc_id"])
        if out:
            out.close()
            system.move(draft, path)

    return rows.select("doc_id", whole_text().alias("text")).mapInArrow(write, f"file string, ordinal long, doc_id {kind}")


def scan_blocks(spark: SparkSession, files: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, n, last, ends) of every block of the flat files ``files`` (file): positions of separators, how many and the last.

    A block is read by its offset alone; no task needs what precedes it.
    """
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            lengths = [system.get_file_info(path).size // TOKEN.itemsize for system, path in map(file_system, names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["file", "tokens"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, counts, last = [], [], []
            for name, block in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                system, path = file_system(name)
                with system.open_input_file(path) as file:
                    file.seek(block * block_tokens * TOKEN.itemsize)
                    tokens = np.frombuffer(file.read(block_tokens * TOKEN.itemsize), TOKEN)
                found = np.flatnonzero(tokens == separator) + block * block_tokens
                ends.append(found)
                counts.append(len(found))
                last.append(int(found[-1]) if len(found) else None)
            columns = [*batch.columns, pa.array(counts, pa.int64()), pa.array(last, pa.int64()), pa.array(ends, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "tokens", "n", "last", "ends"])

    listed = files.select("file").distinct().mapInArrow(sizes, "file string, tokens long").where("tokens > 0")
    blocks = listed.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block"), "tokens")
    return blocks.mapInArrow(search, "file string, block long, tokens long, n long, last long, ends array<long>")


def count_tokens(lineage: Lineage, blocks: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of the documents of scanned files.

    Blocks are stitched by a prefix scan over one row a block: how many
    documents ended before, and where the last one did. Tokens count without
    the separator; what follows the last separator of a file is a document that
    has not ended.
    """
    blocks = lineage.cut(blocks)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("begin"))
    carried = lineage.cut(carried)
    inside = attach(blocks, carried, ["file", "block"])
    pairs = F.arrays_zip(F.concat(F.array("begin"), F.transform("ends", lambda e: e + 1)).alias("start"), F.col("ends").alias("end"))
    ended = inside.where("n > 0").select("file", "ahead", F.posexplode(F.slice(pairs, 1, F.col("n").cast("int"))).alias("k", "d"))
    ended = ended.select(
        "file", (F.col("ahead") + F.col("k")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"),
        F.lit(True).alias("ended"))
    whole = blocks.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("tokens").alias("tokens"))
    rest = whole.where("tokens > start").select("file", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def documents(spark: SparkSession, rows: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token counts of ``rows`` (doc_id, text), read back from flat files.

    A null text counts as empty, and an empty one has no tokens but its
    separator; texts that repeat count each; a null doc_id is kept; an empty
    table writes no file and gives an empty result. Other columns are ignored.

    Columns: doc_id, file, ordinal, start (of the document in its file), n_tokens, ended.
    """
    lineage = Lineage(spark)
    manifest = lineage.cut(write_token_files(rows, new_folder(spark, "tokens"), vocabulary))
    counted = count_tokens(lineage, scan_blocks(spark, manifest, block_tokens=block_tokens))
    return manifest.join(counted, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens", "ended")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return documents(spark, docs).withColumn("file", F.element_at(F.split("file", "/"), -1))
