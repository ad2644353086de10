"""Change of PageRank in many scenarios, from the residual that their overrides leave on the base solution.

The base graph is solved once. A scenario's new weights change few rows of the
transition table; what those changes do to the base solution is its residual, a
short table ``scenario, node, mass``, and the change of the solution solves the
same equation with that residual in place of the restart vector::

    delta = d P_s' delta + residual

Scenarios go through the rounds of ``blocks`` together, as dense vectors beside
one layout of the arcs, so a round shuffles pieces of vectors, not a row for
every arc and scenario. What is left at the end is measured, and the rounds go
on until it is below the tolerance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshflux.operators import blocks, propagation
from meshflux.operators.propagation import Scenario, _numbered, _require_symmetric, both_ways, laid_out, rounds_needed, scenario_shares
from meshflux.session import Lineage, loop_lineage
from meshflux.settings import DAMPING

#: Scenarios whose vectors meet in one loop; more go through several loops.
SCENARIOS_PER_LOOP = 128
#: So many in any case, and more while the values that a block gets in a round stay below a bound.
LEAST_PER_LOOP, VALUES_PER_BLOCK = 12, 16_000_000


def deltas(
    arcs: DataFrame, overrides: DataFrame, *, damping: float = DAMPING, symmetric: bool = True, tolerance: float = 1e-11,
    base: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Base ranks ``id, pagerank`` and the changes of unscaled ranks ``scenario_id, id, delta`` of the nodes that move.

    ``scale`` of a scenario, the sum of its unscaled ranks, is 1 plus the sum of
    its deltas. The sum of what is neglected in a scenario is below
    ``tolerance``. Scenarios without overrides, and overrides that change
    nothing, give no rows. ``base`` spares the base solution where it is known.
    """
    spark = arcs.sparkSession
    lineage = Lineage(spark)
    names, numbered, shape = laid_out(lineage, arcs, None if base is None else base.select("id"), symmetric)
    if base is None:
        loop = loop_lineage(spark)
        solved = propagation._solve_block(loop, numbered, shape, [Scenario("base", damping)], None, None, symmetric, tolerance / 10)
        base = lineage.cut(propagation._long_form(lineage.read(solved), names, [Scenario("base", damping)]).select("id", "pagerank"))
    own = lineage.cut(_numbered(overrides.select("scenario_id", "src", "dst", "weight"), names, "src", "dst"))
    if symmetric:
        _require_symmetric(own, "scenario_id")
    start = lineage.cut(base.join(names, "id").select("number", "pagerank"))
    labels = [r[0] for r in own.select("scenario_id").distinct().orderBy("scenario_id").collect()]
    side = blocks.side_of(shape["nodes"], shape["arcs"], shape["hottest"], propagation.HOT_DEGREE)
    per_loop = min(SCENARIOS_PER_LOOP, max(LEAST_PER_LOOP, VALUES_PER_BLOCK // -(-shape["nodes"] // side))) if symmetric else min(SCENARIOS_PER_LOOP, LEAST_PER_LOOP)
    found = None
    for k in range(0, len(labels), per_loop):
        some = labels[k : k + per_loop]
        part = _solve(lineage, numbered, own, some, start, shape, damping, symmetric, tolerance)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return base, spark.createDataFrame([], "scenario_id string, id string, delta double")
    return base, lineage.cut(found.join(names, "number").select("scenario_id", "id", "delta"))


def _solve(
    lineage: Lineage, arcs: DataFrame, overrides: DataFrame, labels: list[str], start: DataFrame, shape: dict, damping: float,
    symmetric: bool, tolerance: float,
) -> DataFrame | None:
    """``scenario_id, number, delta`` of the nodes that move in some of the scenarios."""
    some = overrides.where(F.col("scenario_id").isin(*labels))
    first = lineage.cut(_left_by(arcs, some, labels, start, damping, symmetric))
    mass = first.groupBy("scenario").agg(F.sum(F.abs("value")).alias("mass")).agg(F.max("mass")).first()[0] or 0.0
    enough = tolerance * (1 - damping)
    if mass <= enough:
        return None
    loop = loop_lineage(lineage.spark)
    side = blocks.side_of(shape["nodes"], shape["arcs"], shape["hottest"], propagation.HOT_DEGREE)
    shares = lineage.cut((both_ways if symmetric else scenario_shares)(arcs, overrides, labels))
    rounds = blocks.Rounds(loop, loop.read(shares), shape["nodes"], side, [damping] * len(labels))
    try:
        if symmetric:
            state = rounds.solve(loop.read(first), [1.0] * len(labels), enough, rounds_needed(damping, min(0.5, enough / mass / 10), True))
        else:
            state = rounds.start(loop.read(first), [1.0] * len(labels))
            while mass > enough:
                state = rounds.iterate(state, max(2, rounds_needed(damping, min(0.5, enough / mass / 10), False)), False)
                mass = max(rounds.left(state).values())
        wide = lineage.read(rounds.rows(state))
    finally:
        rounds.close()
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("scenario_id"), F.col(f"x{i}").alias("delta")) for i, name in enumerate(labels)]))
    return wide.select("number", each.alias("_d")).select("_d.scenario_id", "number", "_d.delta").where("delta != 0")


def _left_by(arcs: DataFrame, overrides: DataFrame, labels: list[str], start: DataFrame, damping: float, symmetric: bool) -> DataFrame:
    """``scenario, number, value``: what the new weights of each scenario do to the base solution.

    All arcs of a source change their share as soon as one of its weights does;
    strengths are summed anew, as a difference of sums would lose the digits of
    a node that keeps little.
    """
    if symmetric:
        arcs = both_ways(arcs, None, labels).select("src", "dst", F.col("share").alias("weight"))
    named = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(labels) for x in (n, k)]), F.col("scenario_id")).alias("scenario")
    fresh = overrides.groupBy("scenario_id", "src", "dst").agg(F.max("weight").alias("weight")).select(named, "src", "dst", F.col("weight").alias("changed"))
    fresh = Lineage(arcs.sparkSession).cut(fresh)
    touched = fresh.select("scenario", "src").distinct()
    near = arcs.select("src", "dst", "weight").join(touched.select("src").distinct(), "src", "left_semi")
    rows = near.join(touched, "src").join(fresh, ["scenario", "src", "dst"], "left")
    rows = Lineage(arcs.sparkSession).cut(rows.select("scenario", "src", "dst", "weight", F.coalesce("changed", "weight").alias("after")))
    sums = rows.groupBy("scenario", "src").agg(F.sum("weight").alias("s"), F.sum("after").alias("t"))
    share = lambda weight, strength: F.coalesce(F.when(F.col(strength) > 0, F.col(weight) / F.col(strength)), F.lit(0.0))
    added = rows.join(sums, ["scenario", "src"]).withColumn("dp", share("after", "t") - share("weight", "s")).where("dp != 0")
    added = added.join(start.withColumnRenamed("number", "src"), "src")
    return added.groupBy("scenario", F.col("dst").alias("number")).agg(F.sum(F.col("dp") * damping * F.col("pagerank")).alias("value")).where("value != 0")
