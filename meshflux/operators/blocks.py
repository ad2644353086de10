"""Rounds of ``x = d P'x + q`` on blocks of arcs and dense pieces of vectors.

Node numbers run from 0 without gaps. Number n lies in piece ``n % side`` at
place ``n // side``, and an arc in the block (piece of its source, piece of its
end). In a round every block of arcs, one task, gets the piece of its sources
and sends one sum for the piece of its ends::

    pieces  COGROUP  blocks ON block  ->  partial sums  GROUP BY piece  ->  new pieces

so a node costs 16 bytes of shuffle for each of the ``side`` pieces and 24 more,
however many arcs it has. Blocks stay cached, partitioned by their key. An arc whose share
differs between scenarios holds one share for each of them, all others hold one.

Symmetric graphs keep weights in their blocks, not shares, and are solved by conjugate
gradients (``Rounds.solve``): strengths are one round over a vector of ones, so
a scenario has values of its own only on the arcs whose weights it changes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflux.session import Lineage

#: Pieces of a graph that one task could hold, for the sake of parallel tasks.
LEAST_SIDE = 3
ARCS_WORTH_A_TASK = 50_000
MOST_ARCS_PER_BLOCK = 24_000_000
NODES_PER_PIECE = 2_500_000
#: Arcs that a task packs at a time.
ARCS_PER_PACK = 1_000_000

PACKED = "key long, width int, src binary, dst binary, share binary"
STATE = "piece int, scenario int, x binary, before binary, q binary"
#: Solution, residual, direction and its product, constant part, strengths; and sums over the nodes of a piece.
DESCENT = "piece int, scenario int, x binary, r binary, p binary, z binary, q binary, s binary, rr double, pz double, rz double, zz double, gap double, mass double"
SUMS = ("rr", "pz", "rz", "zz", "gap", "mass")
#: Rounds in one job; their shuffle files stay until it ends.
ROUNDS_PER_CUT = 9


def side_of(nodes: int, arcs: int, hottest: int, hot: int) -> int:
    """Pieces of a vector: as few as keep blocks, pieces and the arcs of one node in one block within bounds."""
    return max(1, min(LEAST_SIDE, math.ceil(math.sqrt(arcs / ARCS_WORTH_A_TASK))), math.ceil(math.sqrt(arcs / MOST_ARCS_PER_BLOCK)),
               math.ceil(nodes / NODES_PER_PIECE), math.ceil(hottest / hot))


def dense_numbers(ids: DataFrame) -> DataFrame:
    """``id, number`` from 0 without gaps; ``ids`` is a written table with ``number`` by ``monotonically_increasing_id``."""
    part = F.shiftright("number", 33)
    counts = {r["part"]: r["n"] for r in ids.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a task
    offsets, before = [], 0
    for place in sorted(counts):
        offsets.append((place, before - (place << 33)))
        before += counts[place]
    table = ids.sparkSession.createDataFrame(offsets, "part long, offset long")
    return ids.withColumn("part", part).join(F.broadcast(table), "part").select("id", (F.col("number") + F.col("offset")).alias("number"))  # one row a task


def block_keys(spark: SparkSession, tasks: int) -> np.ndarray:
    """A key for each block that hashes into a task of its own."""
    seen = spark.range(64 * tasks + 64).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("task")).collect()
    keys: dict[int, int] = {}
    for row in seen:
        keys.setdefault(row["task"], row["id"])
    spare = iter(range(64 * tasks + 64, 65 * tasks + 64))
    return np.array([keys.get(t, next(spare)) for t in range(tasks)], dtype=np.int64)


class Rounds:
    """Arcs ``src, dst, share, own`` in blocks, ``own`` null or one share a scenario, and rounds over them."""

    def __init__(self, loop: Lineage, arcs: DataFrame, nodes: int, side: int, dampings: Sequence[float]):
        self.loop, self.nodes, self.side, self.dampings = loop, nodes, side, list(dampings)
        self.size = -(-nodes // side)
        self.constants = [0.0] * len(self.dampings)
        self.tasks = side * side
        loop.spark.conf.set("spark.sql.shuffle.partitions", str(self.tasks))
        self.keys = block_keys(loop.spark, self.tasks)
        self.flow = _packed(arcs, side, self.keys, len(self.dampings)).repartition(self.tasks, "key").sortWithinPartitions("key").persist()

    def close(self) -> None:
        self.flow.unpersist()

    def grid(self) -> DataFrame:
        width = len(self.dampings)
        cells = self.loop.spark.range(0, self.side * width, 1, min(self.side * width, self.tasks))
        return cells.select((F.col("id") / F.lit(width)).cast("int").alias("piece"), (F.col("id") % F.lit(width)).cast("int").alias("scenario"))

    def start(self, values: DataFrame | float, parts: Sequence[float]) -> DataFrame:
        """State whose x is a vector and whose q is ``parts[scenario]`` times it.

        The vector holds one value, or those of ``number, scenario, value`` and 0 where there is no row.
        """
        size, side = self.size, self.side
        names = ["piece", "scenario", "x", "before", "q"]
        if not isinstance(values, DataFrame):
            # A constant q stays with the rounds and is not sent.
            self.constants = [part * values for part in parts]

            def same(batches):
                for batch in batches:
                    for k in range(batch.num_rows):
                        x = pa.array([np.full(size, values).tobytes()], pa.binary())
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), x, x, pa.nulls(1, pa.binary())], names=names)

            return self.loop.cut(self.grid().mapInArrow(same, STATE))

        def fill(cells, rows):
            x = np.zeros(size)
            if rows.num_rows:
                np.add.at(x, rows.column("number").to_numpy() // side, rows.column("value").to_numpy())
            q = x * parts[cells.column("scenario")[0].as_py()]
            binary = [pa.array([v.tobytes()], pa.binary()) for v in (x, x, q)]
            return pa.table([cells.column("piece"), cells.column("scenario"), *binary], names=names)

        rows = values.select((F.col("number") % F.lit(side)).cast("int").alias("piece"), F.col("scenario").cast("int").alias("scenario"), "number", "value")
        both = self.grid().groupBy("piece", "scenario").cogroup(rows.groupBy("piece", "scenario"))
        return self.loop.cut(both.applyInArrow(fill, STATE))

    def step(self, state: DataFrame, factors: Sequence[float] | None) -> DataFrame:
        """One round of ``state`` (piece, scenario, x, before, q): ``d P'x + q``, or with ``factors`` the Chebyshev step from ``before``.

        The state is read once, so a chain of rounds is linear in the plan: the
        block on the diagonal hands it on to the next pieces.
        """
        side, size, keys, dampings, constants = self.side, self.size, self.keys, self.dampings, self.constants

        def spread(batches):
            names = ["key", "piece", "scenario", "x", "before", "q"]
            for batch in batches:
                for k in range(batch.num_rows):
                    one, none = batch.slice(k, 1), pa.nulls(1, pa.binary())
                    at = one.column(0)[0].as_py()
                    for onto in range(side):
                        own = [one.column(3), one.column(4)] if onto == at else [none, none]
                        yield pa.RecordBatch.from_arrays([pa.array([int(keys[at * side + onto])], pa.int64()), pa.array([onto], pa.int32()), one.column(1), one.column(2), *own], names=names)

        def multiply(arcs, pieces):
            rows = []
            folds = [runs(np.frombuffer(arcs.column("dst")[k].as_buffer(), dtype=np.int32)) for k in range(arcs.num_rows)]
            for row in range(pieces.num_rows):
                onto, scenario, sent, before, q = (pieces.column(c)[row] for c in ("piece", "scenario", "x", "before", "q"))
                x, total = np.frombuffer(sent.as_buffer()), np.zeros(size)
                for k in range(arcs.num_rows):
                    src = np.frombuffer(arcs.column("src")[k].as_buffer(), dtype=np.int32)
                    starts, ends = folds[k]
                    share = np.frombuffer(arcs.column("share")[k].as_buffer())
                    if arcs.column("width")[k].as_py() > 1:
                        share = share[scenario.as_py() * len(src):(scenario.as_py() + 1) * len(src)]
                    total[ends] += np.add.reduceat(share * x[src], starts)
                own = before.is_valid
                rows.append((onto.as_py(), scenario.as_py(), total.tobytes(), sent.as_py() if own else None, before.as_py(), q.as_py()))
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["piece", "scenario", "sum", "x", "before", "q"])

        def update(rows):
            scenario, total = rows.column("scenario")[0].as_py(), np.zeros(size)
            own = next(k for k in range(rows.num_rows) if rows.column("before")[k].is_valid)
            for k in range(rows.num_rows):
                total += np.frombuffer(rows.column("sum")[k].as_buffer())
            x, before, q = (rows.column(c)[own] for c in ("x", "before", "q"))
            fresh = dampings[scenario] * total + (np.frombuffer(q.as_buffer()) if q.is_valid else constants[scenario])
            if factors is not None:
                held = np.frombuffer(before.as_buffer())
                fresh = factors[scenario] * (fresh - held) + held
            return pa.table([rows.column("piece").slice(own, 1), rows.column("scenario").slice(own, 1), pa.array([fresh.tobytes()], pa.binary()),
                             pa.array([x.as_py()], pa.binary()), pa.array([q.as_py()], pa.binary())], names=["piece", "scenario", "x", "before", "q"])

        sent = state.mapInArrow(spread, "key long, piece int, scenario int, x binary, before binary, q binary")
        sums = self.flow.groupBy("key").cogroup(sent.groupBy("key")).applyInArrow(multiply, "piece int, scenario int, sum binary, x binary, before binary, q binary")
        return sums.groupBy("piece", "scenario").applyInArrow(update, STATE)

    def iterate(self, state: DataFrame, rounds: int, accelerated: bool) -> DataFrame:
        """The state after some rounds; on symmetric weights by the Chebyshev recurrence. Drops the state it starts from."""
        factors = None
        for done in range(rounds):
            if accelerated and done:
                factors = [1 / (1 - d * d / 4 * f) for d, f in zip(self.dampings, factors or [2.0] * len(self.dampings), strict=True)]
            if done % ROUNDS_PER_CUT == 0:
                held = state
            state = self.step(state, factors)
            if done % ROUNDS_PER_CUT == ROUNDS_PER_CUT - 1 or done == rounds - 1:
                state = self.loop.cut(state)
                self.loop.drop(held)
        return state

    def left(self, state: DataFrame) -> dict[int, float]:
        """Sum of the absolute values that the state of each scenario leaves of its equation, ``d P'x + q - x``."""
        def add(batches):
            for batch in batches:
                gaps = [float(np.abs(np.frombuffer(x.as_buffer()) - np.frombuffer(y.as_buffer())).sum()) for x, y in zip(batch.column("x"), batch.column("before"), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("scenario"), pa.array(gaps, pa.float64())], names=["scenario", "gap"])

        gaps = self.step(state, None).mapInArrow(add, "scenario int, gap double")
        return {r["scenario"]: r["gap"] for r in gaps.groupBy("scenario").agg(F.sum("gap").alias("gap")).collect()}

    def solve(self, values: DataFrame | float, parts: Sequence[float], enough: float, most: int) -> DataFrame:
        """``piece, scenario, x``: the solution for ``q`` as in ``start``, by conjugate gradients on symmetric weights in the blocks.

        Rounds are as many as the spectrum of the graph needs, not as its worst case
        would. They end when the absolute values that are left of the equation sum to
        ``enough`` at most, which is measured anew at the end; ``most`` rounds without
        that start again from the measured rest. Where a new start does not halve
        what is left, doubles do not hold more digits.
        """
        state, last = self._first(values, parts), math.inf
        while True:
            factors = {k: (0.0, 0.0) for k in range(len(self.dampings))}
            for _ in range(most):
                state = self._replace(state, self._descend(state, factors))
                sums = self._sums_of(state)
                if all(row["gap"] <= enough for row in sums.values()):
                    factors = {k: (0.0, 0.0) for k in sums}
                    break
                bounds = []
                for k, row in sums.items():
                    along = row["rr"] / row["pz"] if row["rr"] > 0 and row["pz"] > 0 else 0.0
                    left = max(row["rr"] - 2 * along * row["rz"] + along * along * row["zz"], 0.0)
                    factors[k] = (along, left / row["rr"] if row["rr"] > 0 else 0.0)
                    # The sum of absolute values is at most the weighted norm times the root of all strengths.
                    bounds.append(min(row["gap"], math.sqrt(left * row["mass"])) if along else row["gap"])
                if max(bounds) <= enough:
                    break
            state = self._replace(state, self._measured(state, factors))
            gap = max(row["gap"] for row in self._sums_of(state).values())
            if gap <= enough or not gap < last / 2:
                return state.select("piece", "scenario", "x")
            last = gap

    def _replace(self, old: DataFrame, new: DataFrame) -> DataFrame:
        fresh = self.loop.cut(new)
        self.loop.drop(old)
        return fresh

    def _sums_of(self, state: DataFrame) -> dict:
        sums: dict[int, dict[str, float]] = {}
        for row in state.select("scenario", *SUMS).collect():  # one row a piece and scenario
            held = sums.setdefault(row["scenario"], dict.fromkeys(SUMS, 0.0))
            for name in SUMS:
                held[name] += row[name]
        return sums

    def _products(self, state: DataFrame, vector) -> DataFrame:
        """``piece, scenario, sum``: what the blocks make of the vector that a function takes from each row of the state."""
        side, size, keys = self.side, self.size, self.keys

        def spread(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    at, sent = one.column("piece")[0].as_py(), pa.array([vector(one).tobytes()], pa.binary())
                    for onto in range(side):
                        yield pa.RecordBatch.from_arrays([pa.array([int(keys[at * side + onto])], pa.int64()), pa.array([onto], pa.int32()), one.column("scenario"), sent], names=["key", "piece", "scenario", "sent"])

        def multiply(arcs, pieces):
            blocks = [(np.frombuffer(arcs.column("src")[k].as_buffer(), dtype=np.int32), *runs(np.frombuffer(arcs.column("dst")[k].as_buffer(), dtype=np.int32)),
                       np.frombuffer(arcs.column("share")[k].as_buffer()), arcs.column("width")[k].as_py()) for k in range(arcs.num_rows)]
            rows = []
            for k in range(pieces.num_rows if blocks else 0):
                scenario, x, total = pieces.column("scenario")[k].as_py(), np.frombuffer(pieces.column("sent")[k].as_buffer()), np.zeros(size)
                for src, starts, ends, share, width in blocks:
                    if width > 1:
                        share = share[scenario * len(src):(scenario + 1) * len(src)]
                    total[ends] += np.add.reduceat(share * x[src], starts)
                rows.append((pieces.column("piece")[k].as_py(), scenario, total.tobytes()))
            return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["piece", "scenario", "sum"])

        sent = state.mapInArrow(spread, "key long, piece int, scenario int, sent binary")
        return self.flow.groupBy("key").cogroup(sent.groupBy("key")).applyInArrow(multiply, "piece int, scenario int, sum binary")

    def _gathered(self, state: DataFrame, products: DataFrame, update) -> DataFrame:
        """A function's new row of the state for each old row and the sum of its products."""
        size = self.size

        def gather(rows, sums):
            total = np.zeros(size)
            for k in range(sums.num_rows):
                total += np.frombuffer(sums.column("sum")[k].as_buffer())
            return update(rows, total)

        return state.groupBy("piece", "scenario").cogroup(products.groupBy("piece", "scenario")).applyInArrow(gather, DESCENT)

    def _first(self, values: DataFrame | float, parts: Sequence[float]) -> DataFrame:
        """Nothing solved: the residual is the constant part. Strengths are the products of ones."""
        size, side, nodes = self.size, self.side, self.nodes
        state, constants = self.start(values, parts), list(self.constants)

        def begin(rows, total):
            at, scenario = rows.column("piece")[0].as_py(), rows.column("scenario")[0].as_py()
            held, q = len(range(at, nodes, side)), np.zeros(size)
            own = rows.column("q")[0]
            q[:held] = np.frombuffer(own.as_buffer())[:held] if own.is_valid else constants[scenario]
            strength, none = np.where(total > 0, total, 0.0), np.zeros(size)
            mass = float(np.where(strength > 0, strength, 1.0)[:held].sum())
            return _descent(at, scenario, none, q, none, none, q, strength, mass)

        begun = self._gathered(state.select("piece", "scenario", "q"), self._products(state, lambda one: np.ones(size)), begin)
        return self._replace(state, begun)

    def _descend(self, state: DataFrame, factors: dict) -> DataFrame:
        """The step along the last direction, the new direction, and its product."""
        dampings = self.dampings

        def update(rows, total):
            x, r, p, q, s, mass = _advanced(rows, factors)
            scenario = rows.column("scenario")[0].as_py()
            return _descent(rows.column("piece")[0].as_py(), scenario, x, r, p, p - dampings[scenario] * total, q, s, mass)

        return self._gathered(state, self._products(state, lambda one: _per_strength(_advanced(one, factors)[2], one)), update)

    def _measured(self, state: DataFrame, factors: dict) -> DataFrame:
        """The step along the last direction, and what it leaves of the equation, from the solution itself."""
        dampings = self.dampings

        def update(rows, total):
            x, _, _, q, s, mass = _advanced(rows, factors)
            scenario, none = rows.column("scenario")[0].as_py(), np.zeros(len(x))
            return _descent(rows.column("piece")[0].as_py(), scenario, x, q - x + dampings[scenario] * total, none, none, q, s, mass)

        return self._gathered(state, self._products(state, lambda one: _per_strength(_advanced(one, factors)[0], one)), update)

    def rows(self, state: DataFrame) -> DataFrame:
        """``number, x0 .. xk``: one row a node, one column a scenario."""
        width, side, nodes = len(self.dampings), self.side, self.nodes

        def unpack(pieces):
            at = pieces.column("piece")[0].as_py()
            number = np.arange(at, nodes, side, dtype=np.int64)
            held = {pieces.column("scenario")[k].as_py(): np.frombuffer(pieces.column("x")[k].as_buffer())[:len(number)] for k in range(pieces.num_rows)}
            return pa.table([pa.array(number), *[pa.array(held[k]) for k in range(width)]], names=["number", *[f"x{k}" for k in range(width)]])

        return self.loop.cut(state.groupBy("piece").applyInArrow(unpack, "number long, " + ", ".join(f"x{k} double" for k in range(width))))


def runs(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal ends begin, and the end of each; packed arcs have one run for each end."""
    starts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else np.zeros(0, dtype=np.int64)
    return starts, ends[starts]


def _vector(rows, name: str) -> np.ndarray:
    return np.frombuffer(rows.column(name)[0].as_buffer())


def _per_strength(x: np.ndarray, rows) -> np.ndarray:
    """A vector over the strengths of its nodes, 0 where a node has none."""
    s = _vector(rows, "s")
    return np.divide(x, s, out=np.zeros(len(x)), where=s > 0)


def _advanced(rows, factors: dict) -> tuple:
    """``x, r, p, q, s, mass`` of a row after the step that its scenario takes."""
    along, back = factors[rows.column("scenario")[0].as_py()]
    x, r, p, z = (_vector(rows, c) for c in ("x", "r", "p", "z"))
    if along:
        x, r = x + along * p, r - along * z
    return x, r, r + back * p, _vector(rows, "q"), _vector(rows, "s"), rows.column("mass")[0].as_py()


def _descent(at: int, scenario: int, x, r, p, z, q, s, mass: float):
    """One row of the state of ``Rounds.solve``; products weigh a node by 1 / strength."""
    weigh = np.divide(1.0, s, out=np.ones(len(s)), where=s > 0)
    sums = [float(np.dot(a * weigh, b)) for a, b in ((r, r), (p, z), (r, z), (z, z))]
    values = [[at], [scenario], *[[v.tobytes()] for v in (x, r, p, z, q, s)], *[[v] for v in (*sums, float(np.abs(r).sum()), mass)]]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6, *[pa.float64()] * 6]
    return pa.table([pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)], names=["piece", "scenario", "x", "r", "p", "z", "q", "s", *SUMS])


def _packed(arcs: DataFrame, side: int, keys: np.ndarray, width: int) -> DataFrame:
    """Arcs of one block as a few rows of plain arrays; no sort, a task packs what it reads."""
    def pack(batches):
        names = ["key", "width", "src", "dst", "share"]
        held: dict[int, list] = {1: [], width + 1: []}

        def flush(wide):
            src, dst, share = (np.concatenate(part) for part in zip(*held[wide], strict=True))
            held[wide].clear()
            cell, place = (src % side) * side + dst % side, dst // side
            # Arcs of one end lie together, so that a round folds them as one run.
            order = np.argsort(cell * (int(place.max()) + 1) + place, kind="stable")
            ends = np.searchsorted(cell[order], np.arange(side * side + 1))
            for k in range(side * side):
                some = order[ends[k]:ends[k + 1]]
                if len(some):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(keys[k])], pa.int64()), pa.array([wide], pa.int32()), pa.array([(src[some] // side).astype(np.int32).tobytes()], pa.binary()),
                        pa.array([(dst[some] // side).astype(np.int32).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(share[some].T).tobytes()], pa.binary())], names=names)

        for batch in batches:
            src, dst, share = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            own = batch.column(3)
            several = own.value_lengths().to_numpy(zero_copy_only=False) > 0
            if not several.all():
                held[1].append((src[~several], dst[~several], share[~several]))
            if several.any():
                held[width + 1].append((src[several], dst[several], own.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)))
            for wide, parts in held.items():
                if sum(len(p[0]) for p in parts) * wide >= ARCS_PER_PACK:
                    yield from flush(wide)
        for wide, parts in held.items():
            if parts:
                yield from flush(wide)

    # Lists that are null one after the other cost the square of their number on the way to Arrow; empty ones do not.
    own = F.coalesce("own", F.array().cast("array<double>")).alias("own")
    return arcs.select("src", "dst", "share", own).mapInArrow(pack, PACKED)
