"""Symmetric graphs by conjugate gradients: few rounds on graphs that mix fast, few numbered arcs, and the ranks of a dense solve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshflux.operators import blocks
from meshflux.operators.propagation import Scenario, both_ways, pagerank, symmetric_arcs
from meshflux.plans import scenarios
from meshflux.session import Lineage


def dense(weights, damping, n):
    w = np.zeros((n, n))
    for (a, b), x in weights.items():
        w[a, b] = w[b, a] = x
    s = w.sum(1, keepdims=True)
    y = np.linalg.solve(np.eye(n) - damping * np.divide(w, s, out=np.zeros_like(w), where=s > 0).T, np.full(n, (1 - damping) / n))
    return y / y.sum()


def test_few_rounds_where_the_graph_mixes_fast(spark, monkeypatch):
    """A complete graph with a chain, a node without weight, and a scenario: the recurrence takes 45 rounds whatever the graph."""
    weights = {(a, b): 1.0 + (a * b) % 7 for a in range(12) for b in range(a)} | {(0, 12): 0.5, (12, 13): 0.5, (13, 14): 0.0}
    hit = {k: x * 0.01 if 3 in k else x for k, x in weights.items()}
    arcs = symmetric_arcs(spark.createDataFrame([(f"n{a}", f"n{b}", x) for (a, b), x in weights.items()], "src string, dst string, weight double"))
    own = scenarios.overrides_for(arcs, scenarios.scenario_table(spark, {"hit": ["n3"]}, 0.01))
    rounds, first = [], blocks.Rounds._products
    monkeypatch.setattr(blocks.Rounds, "_products", lambda self, *args: (rounds.append(1), first(self, *args))[1])
    got = {(r["scenario_id"], int(r["id"][1:])): r["pagerank"] for r in pagerank(arcs, scenarios=[Scenario("base"), Scenario("hit", 0.7)], overrides=own).collect()}
    assert len(rounds) <= 20
    for name, w, damping in (("base", weights, 0.85), ("hit", hit, 0.7)):
        assert [got[name, k] for k in range(15)] == pytest.approx(list(dense(w, damping, 15)), abs=1e-11)


def test_one_direction_gives_both(spark):
    """Loops stay as often as they are, and only arcs that a scenario changes hold a list."""
    half = spark.createDataFrame([(0, 1, 2.0), (2, 1, 3.0), (1, 1, 4.0), (1, 1, 4.0)], "src long, dst long, weight double")
    own = spark.createDataFrame([("b", 1, 2, 0.5), ("b", 2, 1, 0.5)], "scenario_id string, src long, dst long, weight double")
    got = sorted((r["src"], r["dst"], r["share"], r["own"]) for r in both_ways(half, own, ["a", "b"]).collect())
    assert got == [(0, 1, 2.0, None), (1, 0, 2.0, None), (1, 1, 4.0, None), (1, 1, 4.0, None), (1, 2, 3.0, [3.0, 0.5]), (2, 1, 3.0, [3.0, 0.5])]


def test_arcs_without_lists_are_packed_by_empty_ones(spark):
    """A run of null lists costs the square of its length on the way to the workers."""
    arcs = Lineage(spark).cut(spark.range(6).select(F.col("id").alias("src"), ((F.col("id") + 1) % 6).alias("dst"), F.lit(0.5).alias("share"),
                                                    F.when(F.col("id") == 2, F.array(F.lit(1.0), F.lit(2.0))).alias("own")))
    packed = blocks._packed(arcs, 1, blocks.block_keys(spark, 1), 2)
    assert "coalesce(own" in packed._jdf.queryExecution().optimizedPlan().toString()
    rows = packed.collect()
    assert sum(len(r["src"]) // 4 for r in rows if r["width"] == 1) == 5
    assert [list(np.frombuffer(r["share"])) for r in rows if r["width"] == 3] == [[1.0, 2.0]]
