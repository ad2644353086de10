"""Rounds on blocks of arcs: the same ranks from several pieces, and what a round sends follows the nodes."""

import pytest
from pyspark.sql import functions as F

from meshflux.operators import blocks
from meshflux.operators.propagation import Scenario, pagerank, symmetric_arcs
from meshflux.plans import scenarios
from meshflux.session import Lineage, loop_lineage


def complete(spark, n):
    pairs = [(f"n{a}", f"n{b}", 1.0 + (a * b) % 7) for a in range(n) for b in range(a)]
    return symmetric_arcs(spark.createDataFrame(pairs, "src string, dst string, weight double"))


def test_several_pieces_give_the_ranks_of_one(spark, monkeypatch):
    arcs = complete(spark, 20).unionByName(spark.createDataFrame([("n0", "x", None), ("x", "n0", None)], "src string, dst string, weight double"))
    own = spark.createDataFrame([("hit", a, b, 0.1) for a, b in (("n1", "n2"), ("n2", "n1"))], "scenario_id string, src string, dst string, weight double")
    runs = [Scenario("base", 0.5), Scenario("hit", 0.4)]
    one = {(r["scenario_id"], r["id"]): r["pagerank"] for r in pagerank(arcs, scenarios=runs, overrides=own, tolerance=1e-8).collect()}
    monkeypatch.setattr(blocks, "ARCS_WORTH_A_TASK", 1)
    several = {(r["scenario_id"], r["id"]): r["pagerank"] for r in pagerank(arcs, scenarios=runs, overrides=own, tolerance=1e-8).collect()}
    assert len(one) == 42 and several == pytest.approx(one, abs=1e-12) and sum(one.values()) == pytest.approx(2)
    assert one["hit", "n1"] < one["base", "n1"]


def test_a_round_sends_pieces_not_arcs(spark):
    """380 arcs of 20 nodes: nine blocks, and three pieces of state whatever the number of arcs."""
    numbers = Lineage(spark).cut(complete(spark, 20).select(
        F.substring("src", 2, 9).cast("long").alias("src"), F.substring("dst", 2, 9).cast("long").alias("dst"), (F.col("weight") / 100).alias("share"),
        F.lit(None).cast("array<double>").alias("own")).coalesce(1))
    loop = loop_lineage(spark)
    rounds = blocks.Rounds(loop, loop.read(numbers), 20, 3, [0.5])
    try:
        assert rounds.flow.count() == 9
        state = rounds.iterate(rounds.start(1.0, [1.0]), 1, True)
        assert state.count() == 3
        want = {r["dst"]: 1.0 + 0.5 * r["s"] for r in numbers.groupBy("dst").agg(F.sum("share").alias("s")).collect()}
        assert {r["number"]: r["x0"] for r in rounds.rows(state).collect()} == pytest.approx(want)
    finally:
        rounds.close()


def test_scenarios_share_one_loop_of_blocks(spark, monkeypatch):
    """One layout for the base and one for all scenarios, with the deltas of full solves."""
    arcs, made = complete(spark, 8), []
    table = scenarios.scenario_table(spark, {"a": ["n1"], "b": ["n2", "n3"], "c": ["n4"]}, 0.1)
    want = {(r["scenario_id"], r["id"]): r["delta"] for r in scenarios.what_if(arcs, table, damping=0.3, tolerance=1e-8).collect()}
    first = blocks.Rounds.__init__
    monkeypatch.setattr(blocks.Rounds, "__init__", lambda self, *args: (made.append(len(args[-1])), first(self, *args))[1])
    _, moved = scenarios.what_if_changes(arcs, table, damping=0.3, tolerance=1e-8)
    assert made == [1, 3]
    assert {(r["scenario_id"], r["id"]): r["delta"] for r in moved.collect()} == pytest.approx(want, abs=1e-8)
