"""Repair of conversation structure: faults, cheapest edits by a checkpointed dynamic programme, repaired turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflux.llm import repair_path as path
from meshflux.llm.common import Lineage, keyed, shuffle_partitions

#: Rows of a block: cost vectors of a conversation are kept between blocks only.
BLOCK = 1024
#: Bytes of repaired text in a piece, about.
PIECE = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"

_CODES = "array<int>"
_BLOCKS = f"conv_id {{kind}}, block long, head string, tail string, blank long, duplicate long, truncated long, illegal long, costs array<long>, codes {_CODES}, places array<string>, copies array<int>"


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, place) after damage, with ``copy``: by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes out its marks ``[.!?]``, 3
    repeats it, 4 sets its role to user. A null is one space everywhere.
    """
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return (
        rows.withColumn("kind", kind)
        .where("kind != 0")
        .select(
            "conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("kind") == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), "place",
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
    )


def _described(turns: DataFrame) -> DataFrame:
    """Rows without their texts: initial of the role, digest of role and text, blank and truncated."""
    solid = F.rtrim("text", F.lit(BLANKS))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    return turns.select(
        "conv_id", "turn", "place", "copy", F.substring("role", 1, 1).alias("initial"), F.unhex(said).alias("said"), (solid == "").alias("is_blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("is_cut")
    )


def _illegal(left: str, right: str) -> bool:
    return left + right not in ("su", "ua", "au")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK rows of one conversation, from rows in order."""
    number, held, names = TaskContext.get().partitionId() << 40, [], None

    def flush() -> pa.RecordBatch:
        nonlocal number
        conv, heads, faults, places, copies = held[0][0], [h[1] for h in held], [h[2] for h in held], [h[3] for h in held], [h[4] for h in held]
        codes = [path.code(i, f) for i, f in zip(heads, faults, strict=True)]
        number += 1
        values = [conv, number, heads[0], heads[-1], faults.count(path.BLANK), faults.count(path.DUPLICATE), faults.count(path.TRUNCATED), sum(map(_illegal, heads, heads[1:])), path.matrix(codes), codes, places, copies]
        types = [names, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32())]
        held.clear()
        fields = ["conv_id", "block", "head", "tail", "blank", "duplicate", "truncated", "illegal", "costs", "codes", "places", "copies"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=fields)

    for batch in batches:
        names = batch.column(0).type
        done = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != held[0][0] or len(held) == BLOCK):
                done.append(flush())
            held.append(row)
        yield from done
    if held:
        yield flush()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs after each block, whether it is the last, and what stands on its border; blocks come last first."""
    owner, vector, head = None, None, None
    for batch in batches:
        ends, last, seam = [], [], []
        for conv, _, first, tail, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fresh = vector is None or conv != owner
            end = path.END if fresh else vector
            ends.append(end)
            last.append(fresh)
            seam.append(int(not fresh and _illegal(tail, head)))
            owner, vector, head = conv, path.applied(costs, end), first
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ends, pa.list_(pa.int64())), pa.array(last), pa.array(seam, pa.int64())], names=["block", "end", "is_last", "seam"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a block for each state before it, along the edits taken."""
    for batch in batches:
        found = []
        for codes, end in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            exits = []
            for state in range(path.STATES):
                for _, _, state in path.walk(codes, end, state):  # noqa: B007
                    pass
                exits.append(state)
            found.append(exits)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int32()))], names=["conv_id", "block", "exits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each block; blocks come in order."""
    owner, state, begun = None, 0, False
    for batch in batches:
        found = []
        for conv, _, exits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv != owner:
                owner, state, begun = conv, 0, True
            found.append(state)
            state = exits[state]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.int32())], names=["block", "entry"])


_EDITS = "array<struct<edit:string,before:string,role:string,after:string>>"
_EDIT_TYPE = pa.list_(pa.struct([("edit", pa.string()), ("before", pa.string()), ("role", pa.string()), ("after", pa.string())]))
_COSTS = {"D": path.DELETE, "K": path.KEEP, "R": path.REROLE}


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each block: its letters, its cost, and by row the lines around it and the new role."""
    for batch in batches:
        audits, prices, edits = [], [], []
        for codes, end, entry, is_last in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            letters, price, rows, state = [], 0, [], entry
            for row, (inserted, edit, state) in zip(codes, path.walk(codes, end, entry), strict=True):  # noqa: B007
                letters.append("I" * len(inserted) + edit)
                price += path.INSERT * len(inserted) + _COSTS[edit] + (path.CUT if edit != "D" and row % 4 == path.TRUNCATED else 0)
                rows.append({"edit": edit, "before": "\n".join(f"{r}:" for r in inserted), "role": path.ROLE[state] if edit == "R" else None, "after": ""})
            if is_last and (more := path.ending(state)):
                letters.append("I" * len(more))
                price += path.INSERT * len(more)
                rows[-1]["after"] = "\n".join(f"{r}:" for r in more)
            audits.append("".join(letters))
            prices.append(price)
            edits.append(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(audits), pa.array(prices, pa.int64()), pa.array(edits, _EDIT_TYPE)], names=["block", "audit", "price", "edits"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one block after the other, joined in pieces of about PIECE bytes; rows come in order."""
    kind, owner, lines, size, number = None, None, [], 0, 0

    def flush() -> pa.RecordBatch:
        nonlocal lines, size, number
        piece = pa.RecordBatch.from_arrays([pa.array([owner[0]], kind), pa.array([owner[1]], pa.int64()), pa.array([number], pa.int32()), pa.array(["\n".join(lines).encode()], pa.binary())], names=["conv_id", "block", "piece", "body"])
        lines, size, number = [], 0, number + 1
        return piece

    for batch in batches:
        kind = batch.column(0).type
        for conv, block, line in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if lines and ((conv, block) != owner or size >= PIECE):
                yield flush()
            if (conv, block) != owner:
                owner, number = (conv, block), 0
            lines.append(line)
            size += len(line)
    if lines:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each conversation, in order, with a newline between; one piece is held at a time."""
    kind, owner, digest = None, None, None
    for batch in batches:
        kind, found = batch.column(0).type, []
        for conv, body in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            if digest is not None and conv == owner:
                digest.update(b"\n")
            else:
                if digest is not None:
                    found.append((owner, digest.hexdigest()))
                owner, digest = conv, hashlib.sha256()
            digest.update(body.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], kind), pa.array([d for _, d in found], pa.string())], names=["conv_id", "sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([owner], kind), pa.array([digest.hexdigest()])], names=["conv_id", "sha256"])


def plan(lineage: Lineage, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``turns`` (conv_id, turn, role, text, place, copy) with their edits, and (block, seam) counts of their borders.

    ``place`` and ``copy`` name a row. Turns come by number, nulls first; rows
    of one number by the SHA-256 of role and text, then by place. A block has
    the matrix of costs from each state before it to each state after it; the
    costs after every block follow from those matrices alone, last block first,
    and the states before every block from the blocks' exits, first block first.
    So a task holds one block of rows, however long a conversation is.
    """
    spark, n = lineage.spark, shuffle_partitions(lineage.spark)
    rows = lineage.cut(_described(turns))
    first = rows.groupBy("conv_id", "said").agg(F.min(F.struct("turn", "place", "copy")).alias("first")).select("first.place", "first.copy", F.lit(True).alias("is_first"))
    fault = F.when(F.col("is_blank"), path.BLANK).when(F.col("is_first").isNull(), path.DUPLICATE).when(F.col("is_cut"), path.TRUNCATED).otherwise(path.SOUND)
    known = rows.join(first, ["place", "copy"], "left").select("conv_id", "turn", "said", "place", "copy", "initial", fault.alias("fault"))
    order = ["conv_id", "turn", "said", "place", "copy"]
    sorted_ = known.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "initial", "fault", "place", "copy")
    kind = turns.schema["conv_id"].dataType.simpleString()
    blocks = lineage.cut(sorted_.mapInArrow(_blocks, _BLOCKS.format(kind=kind)))
    lineage.drop(rows)
    borders = blocks.select("conv_id", "block", "head", "tail", "costs").repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    ends = lineage.cut(borders.mapInArrow(_ends, "block long, end array<long>, is_last boolean, seam long"))
    exits = blocks.join(ends, "block").select("conv_id", "block", "codes", "end").mapInArrow(_exits, f"conv_id {kind}, block long, exits array<int>")
    entries = exits.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_entries, "block long, entry int")
    edits = blocks.join(ends, "block").join(entries, "block").select("block", "codes", "end", "entry", "is_last").mapInArrow(_edits, f"block long, audit string, price long, edits {_EDITS}")
    return lineage.cut(blocks.drop("codes", "costs").join(edits, "block")), ends.select("block", "seam")


def repaired(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, block, place_in_block, line) of every repaired turn and what is inserted around it; a line may hold several turns."""
    each = planned.select("conv_id", "block", "places", "copies", F.posexplode("edits").alias("k", "e"))
    each = each.select(F.col("conv_id").alias("conv"), "block", "k", F.element_at("places", F.col("k") + 1).alias("place"), F.element_at("copies", F.col("k") + 1).alias("copy"), "e.*")
    both = each.where("edit != 'D' OR before != '' OR after != ''").join(turns.select("place", "copy", F.col("role").alias("own"), "text"), ["place", "copy"])
    own = F.when(F.col("edit") != "D", F.concat(F.coalesce("role", "own"), F.lit(":"), "text"))
    line = F.concat_ws("\n", F.nullif("before", F.lit("")), own, F.nullif("after", F.lit("")))
    return both.select(F.col("conv").alias("conv_id"), "block", F.col("k").alias("place_in_block"), line.alias("line"))


def repair(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired turns' digest of every conversation of ``rows`` (conv_id, turn, role, text) after ``damaged``.

    Edits make the role initials ``(s?(ua)+)?``; a turn whose initial is none of
    s, u, a (an empty role too) can be reroled or deleted, not kept. A
    conversation all of whose rows are dropped has zeros, no edits and the hash of nothing.
    Rows of a null conv_id are one conversation; a null turn comes first;
    repeated rows are duplicates of the first; other columns are ignored; an
    empty table gives an empty result. Texts of any length are hashed whole, a
    piece at a time; a conversation's audit is one value, of one letter an edit.
    """
    lineage, n = Lineage(spark), shuffle_partitions(spark)
    placed, key = keyed(rows.select("conv_id", "turn", "role", "text"))
    turns = damaged(placed.withColumnRenamed(key, "place"))
    planned, seams = plan(lineage, turns)
    kind = rows.schema["conv_id"].dataType.simpleString()
    lines = repaired(turns, planned)
    pieces = lines.repartition(n, "block").sortWithinPartitions("conv_id", "block", "place_in_block").mapInArrow(_pieces, f"conv_id {kind}, block long, piece int, body binary")
    digests = pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block", "piece").mapInArrow(_digests, f"conv_id {kind}, sha256 string")
    steps = F.sort_array(F.collect_list(F.struct("block", "audit")))
    summary = planned.join(seams, "block").groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.col("seam")).alias("illegal"), F.sum("price").alias("cost"),
        F.array_join(F.transform(steps, lambda s: s["audit"]), "").alias("audit"))
    spans = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    found = rows.select("conv_id").distinct().alias("o")
    for name, table in (("s", summary), ("g", spans), ("d", digests)):
        found = found.join(table.alias(name), F.col("o.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256().hexdigest()
    return found.select("o.conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repair`` over all conversations."""
    return repair(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
