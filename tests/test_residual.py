"""Residual propagation against full solves of every scenario."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshflux.operators import residual
from meshflux.operators.propagation import symmetric_arcs
from meshflux.plans import scenarios as p


def graph(spark, seed=4, n=60, m=160):
    draw = np.random.default_rng(seed)
    pairs = {tuple(sorted(x)) for x in draw.integers(0, n, (m, 2)).tolist() if x[0] != x[1]}
    rows = [(f"n{a}", f"n{b}", float(draw.uniform(0.05, 1))) for a, b in sorted(pairs)]
    return spark.createDataFrame(rows, "src string, dst string, weight double"), rows


def solved(rows, factors, damping=0.85):
    """Ranks of one scenario by a dense solve."""
    ids = sorted({x for a, b, _ in rows for x in (a, b)})
    at = {x: k for k, x in enumerate(ids)}
    w = np.zeros((len(ids),) * 2)
    for a, b, x in rows:
        x *= min(factors.get(a, 1.0), factors.get(b, 1.0))
        w[at[a], at[b]] = w[at[b], at[a]] = x
    s = w.sum(1, keepdims=True)
    p_ = np.divide(w, s, out=np.zeros_like(w), where=s > 0)
    y = np.linalg.solve(np.eye(len(ids)) - damping * p_.T, np.full(len(ids), (1 - damping) / len(ids)))
    return dict(zip(ids, y / y.sum(), strict=True))


SETS = {"one": (["n1"], 0.001), "two": (["n2", "n3"], 0.5), "many": ([f"n{k}" for k in range(20)], 0.05), "same": (["n4"], 1.0), "cut": (["n5"], 0.0)}


def test_equal_to_a_dense_solve(spark):
    edges, rows = graph(spark)
    arcs = symmetric_arcs(edges)
    table = p.scenario_table(spark, {k: t for k, (t, _) in SETS.items()}, {k: f for k, (_, f) in SETS.items()})
    got = {(r.scenario_id, r.id): r for r in p.what_if_by_residuals(arcs, table).collect()}
    base = solved(rows, {})
    assert len(got) == len(SETS) * len(base)
    for name, (targets, factor) in SETS.items():
        want = solved(rows, dict.fromkeys(targets, factor))
        for node, rank in want.items():
            r = got[name, node]
            assert abs(r.baseline - base[node]) < 1e-9 and abs(r.perturbed - rank) < 1e-9 and abs(r.delta - (rank - base[node])) < 1e-9
    assert {got["same", n].direction for n in base} == {"no change"}


def test_only_what_moves_has_rows(spark):
    """Two components: a scenario in one leaves the other without rows; several loops give what one gives."""
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("x", "y", 1.0), ("y", "z", 1.0)], "src string, dst string, weight double")
    arcs = symmetric_arcs(edges)
    table = p.scenario_table(spark, {"left": ["a"], "right": ["x"], "none": ["q"]}, 0.1)
    _, moved = p.what_if_changes(arcs, table)
    rows = {(r.scenario_id, r.id): r.delta for r in moved.collect()}
    assert {k for k in rows if abs(rows[k]) > 1e-12} == {("left", n) for n in "abc"} | {("right", n) for n in "xz"}  # y keeps its rank
    assert {k[1] in "abc" for k in rows if k[0] == "left"} == {True} and {s for s, _ in rows} == {"left", "right"}
    before, residual.SCENARIOS_PER_LOOP = residual.SCENARIOS_PER_LOOP, 1
    try:
        again = {(r.scenario_id, r.id): r.delta for r in p.what_if_changes(arcs, table)[1].collect()}
    finally:
        residual.SCENARIOS_PER_LOOP = before
    assert set(again) == set(rows) and max(abs(again[k] - rows[k]) for k in rows) < 1e-11


@pytest.mark.parametrize("iterations", [19])
def test_null_p_values_by_dense_solves(spark, iterations):
    edges, rows = graph(spark, 7, 50, 140)
    arcs = symmetric_arcs(edges)
    table = p.scenario_table(spark, {"hit": ["n1", "n2"]}, 0.05)
    observed = p.without_targets(p.what_if_by_residuals(arcs, table), table)
    got = {r.id: r.empirical_p for r in p.null_p_values(arcs, observed, ["n1", "n2"], factor=0.05, iterations=iterations).collect()}
    degrees = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    draws = {}
    for r in p.degree_matched_draws(degrees, ["n1", "n2"], iterations).collect():
        draws.setdefault(r.scenario_id, []).append(r.id)
    base = solved(rows, {})
    hit = solved(rows, {"n1": 0.05, "n2": 0.05})
    nulls = [solved(rows, dict.fromkeys(ids, 0.05)) for ids in draws.values()]
    assert len(nulls) == iterations
    for node, p_value in got.items():
        reached = sum(abs(x[node] - base[node]) >= abs(hit[node] - base[node]) - 1e-12 for x in nulls)
        assert abs(p_value - (1 + reached) / (iterations + 1)) < 1e-9


def test_report(spark):
    """System shift and efficiency before and after, of every scenario, in closed form: a path of three nodes."""
    edges = spark.createDataFrame([("a", "b", 1.0, 1.0), ("b", "c", 0.5, 2.0)], "src string, dst string, weight double, distance double")
    arcs = symmetric_arcs(edges)
    row = p.what_if_report(arcs, p.scenario_table(spark, {"hit": ["a"]}, 0.5)).collect()[0]
    # 1 / (1 / weight) is the weight; a and c meet over b.
    before = 2 * (1 + 0.5 + 1 / 3) / 6
    after = 2 * (0.5 + 0.5 + 1 / 4) / 6
    assert abs(row.efficiency_before - before) < 1e-12 and abs(row.efficiency_after - after) < 1e-12
    assert abs(row.efficiency_change_pct - (after / before - 1) * 100) < 1e-9
    full = p.system_shift(p.what_if(arcs, p.scenario_table(spark, {"hit": ["a"]}, 0.5))).collect()[0]
    assert abs(row.system_shift_pct - full.system_shift_pct) < 1e-7 and abs(row.total_variation - full.total_variation) < 1e-9
