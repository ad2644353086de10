"""Searches from some sources on blocks of arcs: distances, and the paths behind betweenness.

Nodes are numbered over all keys, and a vector holds the search of one source of
every key, as no arc joins two keys. Vectors lie in pieces and arcs in blocks as
in ``blocks``. A round of distances sends only what improved in the one before
and gets back one least value for each end, whatever the number of arcs; the
rest of a vector is one value repeated, which the shuffle compresses. The arcs on
shortest paths are few, and stay as blocks of their own; walks are counted along
them one arc a round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshflux.operators import blocks
from meshflux.operators.propagation import HOT_DEGREE, _numbered
from meshflux.session import Lineage, loop_lineage

EPSILON = 1e-9
#: Values of all the pieces that a task gets at once.
VALUES_PER_TASK = 16_000_000
#: Turns of the loop beyond which distances go through joins instead, as when every node of a large graph is a source.
MOST_TURNS = 16
#: Share of the nodes that a search has reached from which all arcs are gone through, not those that lead on.
DENSE = 0.1
#: Values of the vectors for each that can be reached at most; beyond, joins are used.
MOST_WASTE = 4
#: Rounds of distances in one job.
ROUNDS_PER_CUT = 3
#: Rows of a result that are handed on at a time.
ROWS_PER_BATCH = 100_000

STATE = "piece int, slot int, x binary, fresh binary, news long"
WAVE = "piece int, slot int, x binary"


class Searches:
    """Arcs ``by.., src, dst, distance`` and up to some sources a key, laid out for rounds."""

    def __init__(self, lineage: Lineage, arcs: DataFrame, names: DataFrame, sources: DataFrame, by: Sequence[str], nodes: int, side: int, most: int):
        self.lineage, self.by, self.nodes, self.side = lineage, list(by), nodes, side
        self.names, self.sources, self.most = names, sources, most
        self.size = -(-nodes // side)
        self.width = max(1, VALUES_PER_TASK // max(self.size, 1))
        self.loop = loop_lineage(lineage.spark)
        self.tasks = side * side
        self.loop.spark.conf.set("spark.sql.shuffle.partitions", str(self.tasks))
        self.keys = blocks.block_keys(self.loop.spark, self.tasks)
        flat = self.loop.read(lineage.cut(arcs.select("src", "dst", F.col("distance").alias("share"), F.lit(None).cast("array<double>").alias("own"))))
        self.flow = self._held(blocks._packed(flat, side, self.keys, 1))

    def _held(self, packed: DataFrame) -> DataFrame:
        return packed.repartition(self.tasks, "key").sortWithinPartitions("key").persist()

    def close(self) -> None:
        self.flow.unpersist()

    def turns(self):
        """The slots of each turn of the loop."""
        for first in range(0, self.most, self.width):
            yield first, min(first + self.width, self.most)

    def start(self, first: int, last: int, rest: float, value: float) -> DataFrame:
        """``piece, slot, x``: a value at the source of each key, and another at all other nodes."""
        size, side = self.size, self.side

        def fill(cells, rows):
            x = np.full(size, rest)
            if rows.num_rows:
                x[rows.column("number").to_numpy() // side] = value
            return pa.table([cells.column("piece"), cells.column("slot"), pa.array([x.tobytes()], pa.binary())], names=["piece", "slot", "x"])

        cells = self.loop.spark.range(side * first, side * last, 1, min(self.tasks, side * (last - first)))
        cells = cells.select((F.col("id") % F.lit(side)).cast("int").alias("piece"), (F.col("id") / F.lit(side)).cast("int").alias("slot"))
        rows = self.loop.read(self.sources).where(F.col("slot").between(first, last - 1)).select(
            (F.col("number") % F.lit(side)).cast("int").alias("piece"), "slot", "number")
        return cells.groupBy("piece", "slot").cogroup(rows.groupBy("piece", "slot")).applyInArrow(fill, WAVE)

    def distances(self, first: int, last: int) -> DataFrame:
        """``piece, slot, x`` of the least distances, infinite where nothing leads."""
        state = self.loop.cut(self.start(first, last, np.inf, 0.0).select("piece", "slot", "x", F.col("x").alias("fresh"), F.lit(1).cast("long").alias("news")))
        while state.agg(F.sum("news")).first()[0]:
            held = state
            for _ in range(ROUNDS_PER_CUT):
                state = self._closer(state)
            state = self.loop.cut(state)
            self.loop.drop(held)
        found = state.select("piece", "slot", "x")
        found._cut_path = state._cut_path
        return found

    def _closer(self, state: DataFrame) -> DataFrame:
        """One round: what improved goes over all arcs, and the least value at each end is kept."""
        side, size, keys = self.side, self.size, self.keys
        none = pa.nulls(1, pa.binary())

        def spread(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    at, news = one.column("piece")[0].as_py(), one.column("news")[0].as_py()
                    for onto in range(side):
                        # The block on the diagonal hands the known distances on.
                        if news or onto == at:
                            yield pa.RecordBatch.from_arrays([
                                pa.array([int(keys[at * side + onto])], pa.int64()), pa.array([onto], pa.int32()), one.column("slot"),
                                one.column("fresh"), one.column("x") if onto == at else none], names=["key", "piece", "slot", "sent", "x"])

        def least(arcs, pieces):
            found, packed = [], [(src, dst, distance, *blocks.runs(dst)) for src, dst, distance in _arcs(arcs)]
            for k in range(pieces.num_rows):
                sent, total = pieces.column("sent")[k], None
                if sent.is_valid and arcs.num_rows:
                    total, base = np.full(size, np.inf), np.frombuffer(sent.as_buffer())
                    dense = np.count_nonzero(base < np.inf) >= DENSE * size
                    for src, dst, distance, starts, ends in packed:
                        if dense:
                            total[ends] = np.minimum(total[ends], np.minimum.reduceat(base[src] + distance, starts))
                            continue
                        some = np.flatnonzero(base[src] < np.inf)
                        np.minimum.at(total, dst[some], base[src[some]] + distance[some])
                    total = total.tobytes() if (total < np.inf).any() else None
                found.append(total)
            return pa.table([pieces.column("piece"), pieces.column("slot"), pa.array(found, pa.binary()), pieces.column("x")], names=["piece", "slot", "found", "x"])

        def keep(rows):
            own = next(k for k in range(rows.num_rows) if rows.column("x")[k].is_valid)
            x = np.frombuffer(rows.column("x")[own].as_buffer())
            best = np.full(size, np.inf)
            for k in range(rows.num_rows):
                if rows.column("found")[k].is_valid:
                    best = np.minimum(best, np.frombuffer(rows.column("found")[k].as_buffer()))
            better = best < x
            news = int(better.sum())
            fresh = [np.where(better, best, np.inf).tobytes() if news else None]
            return pa.table([rows.column("piece").slice(own, 1), rows.column("slot").slice(own, 1), pa.array([np.minimum(x, best).tobytes()], pa.binary()),
                             pa.array(fresh, pa.binary()), pa.array([news], pa.int64())], names=["piece", "slot", "x", "fresh", "news"])

        sent = state.mapInArrow(spread, "key long, piece int, slot int, sent binary, x binary")
        found = self.flow.groupBy("key").cogroup(sent.groupBy("key")).applyInArrow(least, "piece int, slot int, found binary, x binary")
        return found.groupBy("piece", "slot").applyInArrow(keep, STATE)

    def _steps(self, distances: DataFrame) -> DataFrame:
        """Arcs on shortest paths in blocks, one row or more for each slot: ``key, slot, src, dst``."""
        side, keys = self.side, self.keys

        def spread(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    at = one.column("piece")[0].as_py()
                    for other in range(side):
                        for head, cell in ((False, at * side + other), (True, other * side + at)):
                            yield pa.RecordBatch.from_arrays([pa.array([int(keys[cell])], pa.int64()), one.column("slot"), pa.array([head]), one.column("x")],
                                                             names=["key", "slot", "head", "x"])

        def tight(arcs, pieces):
            ends: dict[int, dict[bool, np.ndarray]] = {}
            for k in range(pieces.num_rows):
                ends.setdefault(pieces.column("slot")[k].as_py(), {})[pieces.column("head")[k].as_py()] = np.frombuffer(pieces.column("x")[k].as_buffer())
            rows = []
            for slot, held in ends.items():
                for src, dst, distance in _arcs(arcs):
                    du, dv = held[False][src], held[True][dst]
                    near = np.flatnonzero((dv > du) & (dv < np.inf))
                    du, dv = du[near], dv[near]
                    on = near[np.abs(du + distance[near] - dv) <= EPSILON * np.maximum(1.0, dv)]
                    if len(on):
                        rows.append((slot, src[on].tobytes(), dst[on].tobytes()))
            key = pieces.column("key")[0].as_py() if pieces.num_rows else None
            kinds = [pa.int32(), pa.binary(), pa.binary()]
            return pa.table([pa.array([key] * len(rows), pa.int64()), *[pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]], names=["key", "slot", "src", "dst"])

        sent = distances.mapInArrow(spread, "key long, slot int, head boolean, x binary")
        return self.loop.cut(self.flow.groupBy("key").cogroup(sent.groupBy("key")).applyInArrow(tight, "key long, slot int, src binary, dst binary"))

    def _walks(self, start: DataFrame, steps: DataFrame, backward: bool) -> list[DataFrame]:
        """Values moved along 1, 2, .. of the steps until none is left; one table of ``piece, slot, x`` for each number."""
        side, size, keys = self.side, self.size, self.keys

        def spread(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    at = one.column("piece")[0].as_py()
                    for onto in range(side):
                        cell = onto * side + at if backward else at * side + onto
                        yield pa.RecordBatch.from_arrays([pa.array([int(keys[cell])], pa.int64()), pa.array([onto], pa.int32()), one.column("slot"), one.column("x")],
                                                         names=["key", "piece", "slot", "x"])

        def move(arcs, pieces):
            rows = []
            places: dict[int, list[int]] = {}
            for k, slot in enumerate(arcs.column("slot").to_pylist()):
                places.setdefault(slot, []).append(k)
            for k in range(pieces.num_rows):
                slot, total = pieces.column("slot")[k].as_py(), np.zeros(size)
                x = np.frombuffer(pieces.column("x")[k].as_buffer())
                for row in places.get(slot, ()):
                    src, dst = (np.frombuffer(arcs.column(c)[row].as_buffer(), dtype=np.int32) for c in ("src", "dst"))
                    if backward:
                        src, dst = dst, src
                    np.add.at(total, dst, x[src])
                if total.any():
                    rows.append((pieces.column("piece")[k].as_py(), slot, total.tobytes()))
            return _wave(rows)

        waves = []
        wave = start
        while True:
            sent = wave.mapInArrow(spread, "key long, piece int, slot int, x binary")
            moved = steps.groupBy("key").cogroup(sent.groupBy("key")).applyInArrow(move, WAVE)
            wave = self.loop.cut(moved.groupBy("piece", "slot").applyInArrow(_total, WAVE))
            if wave.isEmpty():
                return waves
            waves.append(wave)

    def dependencies(self, first: int, last: int) -> DataFrame:
        """``piece, x``: for each node the share of shortest paths through it, summed over the sources of some slots."""
        size = self.size
        start = self.loop.cut(self.start(first, last, 0.0, 1.0))
        distances = self.distances(first, last)
        written = self._steps(distances)
        self.loop.drop(distances)
        steps = self._held(written)
        try:
            counts, ahead = start, self._walks(start, steps, False)
            for wave in ahead:
                counts = counts.unionByName(wave)
            counts = self.loop.cut(counts.groupBy("piece", "slot").applyInArrow(_total, WAVE))
            self._forget(*ahead)

            def inverse(batches):
                for batch in batches:
                    rows = []
                    for k in range(batch.num_rows):
                        x = np.frombuffer(batch.column("x")[k].as_buffer())
                        rows.append((batch.column("piece")[k].as_py(), batch.column("slot")[k].as_py(), np.divide(1.0, x, out=np.zeros(size), where=x > 0).tobytes()))
                    yield from _wave(rows).to_batches()

            # What a node hands back is divided by its paths here, and multiplied by those of the node it gets to below.
            inverses = self.loop.cut(counts.mapInArrow(inverse, WAVE))
            waves = self._walks(inverses, steps, True)
        finally:
            steps.unpersist()
            self._forget(written)

        def rate(rows):
            total = {kind: np.zeros(size) for kind in ("start", "count", "wave")}
            for k in range(rows.num_rows):
                total[rows.column("kind")[k].as_py()] += np.frombuffer(rows.column("x")[k].as_buffer())
            value = total["count"] * total["wave"] * (1.0 - total["start"])
            return _wave([(rows.column("piece")[0].as_py(), rows.column("slot")[0].as_py(), value.tobytes())])

        tables = start.withColumn("kind", F.lit("start")).unionByName(counts.withColumn("kind", F.lit("count")))
        for wave in waves:
            tables = tables.unionByName(wave.withColumn("kind", F.lit("wave")))
        rated = tables.groupBy("piece", "slot").applyInArrow(rate, WAVE).withColumn("slot", F.lit(0))
        result = self.loop.cut(rated.groupBy("piece", "slot").applyInArrow(_total, WAVE))
        # A turn leaves one vector, whatever the number of turns.
        self._forget(start, counts, inverses, *waves)
        return result

    def added(self, sums: DataFrame, part: DataFrame) -> DataFrame:
        """The sum of two results of ``dependencies``; neither is kept."""
        fresh = self.loop.cut(sums.unionByName(part).groupBy("piece", "slot").applyInArrow(_total, WAVE))
        self._forget(sums, part)
        return fresh

    def _forget(self, *tables: DataFrame) -> None:
        for table in tables:
            self.loop.drop(table)

    def rows(self, vectors: DataFrame, rest: float) -> DataFrame:
        """``slot, by.., id, value`` of the nodes whose value is not the one given."""
        side, nodes = self.side, self.nodes

        def unpack(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    at, slot = batch.column("piece")[k].as_py(), batch.column("slot")[k].as_py()
                    number = np.arange(at, nodes, side, dtype=np.int64)
                    x = np.frombuffer(batch.column("x")[k].as_buffer())[:len(number)]
                    some = np.flatnonzero(x != rest)
                    for low in range(0, len(some), ROWS_PER_BATCH):
                        part = some[low:low + ROWS_PER_BATCH]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), slot, np.int32)), pa.array(number[part]), pa.array(x[part])], names=["slot", "number", "value"])

        found = self.lineage.read(self.loop.cut(vectors.mapInArrow(unpack, "slot int, number long, value double")))
        return found.join(self.names, "number").select("slot", *[F.col("id")[b].alias(b) for b in self.by], F.col("id")["id"].alias("id"), "value")


def _arcs(table):
    for k in range(table.num_rows):
        src, dst = (np.frombuffer(table.column(c)[k].as_buffer(), dtype=np.int32) for c in ("src", "dst"))
        yield src, dst, np.frombuffer(table.column("share")[k].as_buffer())


def _wave(rows):
    return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["piece", "slot", "x"])


def _total(rows):
    total = np.zeros(len(rows.column("x")[0].as_buffer()) // 8)
    for k in range(rows.num_rows):
        total += np.frombuffer(rows.column("x")[k].as_buffer())
    return _wave([(rows.column("piece")[0].as_py(), rows.column("slot")[0].as_py(), total.tobytes())])


def searches(arcs: DataFrame, sources: DataFrame, by: Sequence[str], turns: int | None = MOST_TURNS) -> Searches | None:
    """Arcs ``by.., src, dst, distance`` and ``by.., source`` laid out, or None where vectors would be wasteful.

    Arcs and sources hold no null but for ``dst``, which may be a node that leads nowhere.
    Arcs are read several times, so they come from a written table.
    """
    by = list(by)
    lineage = Lineage(arcs.sparkSession)
    key = lambda name: F.struct(*by, F.col(name).alias("id"))
    sources = lineage.cut(sources.select(*by, "source").distinct())
    per = sources.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"))
    most = per.agg(F.max("_k")).first()[0]
    if not most:
        return None
    arcs = arcs.select(key("src").alias("src"), key("dst").alias("dst"), "distance")
    ids = arcs.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(sources.select(key("source").alias("id")))
    names = lineage.cut(blocks.dense_numbers(lineage.cut(ids.distinct().withColumn("number", F.monotonically_increasing_id()))))
    sizes = names.groupBy(*[F.col("id")[b].alias(b) for b in by]).agg(F.count(F.lit(1)).alias("_n"))
    both = sizes.join(per, by) if by else sizes.join(F.broadcast(per))  # one row without keys
    row = both.agg(F.sum(F.col("_k") * F.col("_n")).alias("cells")).first()
    nodes = names.count()
    hot = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).agg(F.sum("degree").alias("arcs"), F.max("degree").alias("hottest")).first()
    side = blocks.side_of(nodes, hot["arcs"] or 0, hot["hottest"] or 0, HOT_DEGREE)
    width = max(1, VALUES_PER_TASK // -(-nodes // side))
    if (turns is not None and most > width * turns) or most * nodes > MOST_WASTE * row["cells"]:
        lineage.release()
        return None
    order = Window.partitionBy(*by).orderBy("source")
    slots = sources.withColumn("slot", (F.row_number().over(order) - 1).cast("int")).withColumn("id", key("source"))
    sources = lineage.cut(slots.join(names, "id").select(*by, "source", "slot", "number"))
    return Searches(lineage, _numbered(arcs, names, "src", "dst"), names, sources, by, nodes, side, most)


def whole(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows that hold no null in some columns."""
    return rows.dropna(subset=list(columns))
