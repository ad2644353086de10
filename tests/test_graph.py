"""Closed-form values on graphs of a few nodes."""

import pytest
from pyspark.sql import functions as F

from meshflux.operators import centrality, edges, resilience, signed, traversal
from meshflux.operators import propagation
from meshflux.operators.propagation import Scenario, pagerank, symmetric_arcs
from meshflux.plans import scenarios


def graph(spark, rows):
    table = spark.createDataFrame([(a, b, float(w), 1.0 / w) for a, b, w in rows], "src string, dst string, weight double, distance double")
    return symmetric_arcs(table, "weight", "distance")


def ranks(df):
    return {(r["scenario_id"], r["id"]): r["pagerank"] for r in df.collect()}


def power(arcs, nodes, damping=0.85, rounds=400):
    """Plain power iteration with dangling mass spread evenly."""
    out = {n: sum(w for s, _, w in arcs if s == n) for n in nodes}
    x = {n: 1.0 / len(nodes) for n in nodes}
    for _ in range(rounds):
        lost = sum(x[n] for n in nodes if out[n] == 0)
        x = {n: (1 - damping) / len(nodes) + damping * (lost / len(nodes) + sum(x[s] * w / out[s] for s, d, w in arcs if d == n)) for n in nodes}
    return x


@pytest.mark.parametrize("rows, expected", [
    ([(a, b, 1) for a in "0123" for b in "0123" if a < b], 1.0),
    ([("0", "1", 1), ("2", "3", 1)], 1 / 3),
    ([("0", "1", 1), ("0", "2", 1), ("0", "3", 1)], 0.75),
    ([("0", "1", 1), ("1", "2", 1)], 5 / 6),
    ([("0", "1", 1), ("1", "2", 1), ("0", "2", 0.25)], 5 / 6),
])
def test_global_efficiency(spark, rows, expected):
    assert traversal.global_efficiency(graph(spark, rows)).first()["efficiency"] == pytest.approx(expected)


def test_local_efficiency_of_star_is_zero(spark):
    star = graph(spark, [("0", "1", 1), ("0", "2", 1), ("0", "3", 1)])
    assert traversal.local_efficiency(star).agg(F.avg("efficiency")).first()[0] == 0.0


def test_betweenness_splits_equal_paths(spark):
    square = graph(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "e", 1), ("e", "c", 1)])
    found = {r["id"]: r["betweenness"] for r in centrality.betweenness(square).collect()}
    assert found == pytest.approx({"a": 0.5, "b": 1.0, "c": 3.5, "d": 0.0, "e": 1.0})


def test_directed_pagerank_with_dangling_nodes(spark):
    arcs = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 1.0), ("d", "a", 1.0)]
    got = ranks(pagerank(spark.createDataFrame(arcs, "src string, dst string, weight double"), symmetric=False))
    want = power(arcs, "abcd")
    assert {n: got[("base", n)] for n in "abcd"} == pytest.approx(want, abs=1e-10)


def test_undirected_pagerank_scenarios_and_salting(spark, monkeypatch):
    rows = [("a", "b", 0.5), ("b", "c", 0.8), ("a", "c", 1.0), ("c", "d", 0.2)]
    arcs = graph(spark, rows)
    table = scenarios.scenario_table(spark, {"same": ["a"], "hit": ["a", "b"]}, {"same": 1.0, "hit": 0.1})
    overrides = scenarios.overrides_for(arcs, table)
    runs = [Scenario("base"), Scenario("same"), Scenario("hit"), Scenario("loose", 0.5)]
    together = ranks(pagerank(arcs, scenarios=runs, overrides=overrides))
    both = [(s, d, w) for a, b, w in rows for s, d in ((a, b), (b, a))]
    hit = [(s, d, w * 0.1 if {"a", "b"} & {s, d} else w) for s, d, w in both]
    for name, table_arcs, damping in (("base", both, 0.85), ("same", both, 0.85), ("hit", hit, 0.85), ("loose", both, 0.5)):
        want = power(table_arcs, "abcd", damping)
        assert {n: together[(name, n)] for n in "abcd"} == pytest.approx(want, abs=1e-9)
    # A node above the limit is split over salted partitions without changing the result.
    monkeypatch.setattr(propagation, "HOT_DEGREE", 1)
    split = ranks(pagerank(arcs, scenarios=runs[:3], overrides=overrides))
    assert split == pytest.approx({k: v for k, v in together.items() if k[0] != "loose"}, abs=1e-10)


def test_restart_walk_returns_to_seeds(spark):
    arcs = graph(spark, [("a", "b", 1), ("c", "d", 1)])
    seeds = spark.createDataFrame([("a", 2.0)], "id string, mass double")
    got = ranks(pagerank(arcs, restart=seeds, damping=0.5))
    assert got[("base", "c")] == 0.0 and got[("base", "a")] == pytest.approx(2 / 3) and got[("base", "b")] == pytest.approx(1 / 3)


def test_simplify_ignores_direction_and_copies(spark):
    rows = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("a", "a", 9.0), ("a", "b", 1.0)], "src string, dst string, weight double")
    out = edges.simplify(rows).collect()
    assert [(r["src"], r["dst"], r["weight"], r["distance"]) for r in out] == [("a", "b", 2.0, 0.5)]


def test_components(spark):
    rows = spark.createDataFrame([(str(i), str(i + 1)) for i in range(10, 40)] + [("x", "y")], "src string, dst string")
    found = {r["id"]: r["component"] for r in traversal.components(rows).collect()}
    assert set(found.values()) == {"10", "x"} and len(found) == 33


def test_orient_keeps_pairs(spark):
    base = spark.createDataFrame([("A", "B", 0.37), ("B", "C", 0.5)], "src string, dst string, weight double")
    proof = spark.createDataFrame([("C", "B", "activation", ["r"], ["p"]), ("A", "Z", "activation", ["r"], ["p"])], "src string, dst string, status string, resources array<string>, refs array<string>")
    arcs = {(r["src"], r["dst"]): r["is_fallback"] for r in signed.orient(base, proof).collect()}
    assert arcs == {("A", "B"): True, ("B", "A"): True, ("C", "B"): False}


SIGNED = [("A", "B", "activation"), ("B", "C", "activation"), ("C", "D", "inhibition"), ("A", "E", "inhibition"), ("E", "D", "inhibition"), ("D", "B", "activation"), ("X", "C", "unsigned")]


def test_signed_paths_and_convergence(spark):
    arcs = spark.createDataFrame(SIGNED, "src string, dst string, status string")
    pairs = spark.createDataFrame([("A", "D")], "source string, target string")
    got = signed.summarize_paths(signed.bounded_paths(arcs, pairs)).first()
    assert (got["shortest"], got["path_count"], got["net_sign"], got["positive_paths"], got["negative_paths"]) == (2, 2, "uncertain", 1, 1)
    capped = signed.bounded_paths(arcs, pairs, max_paths=1).collect()
    assert len(capped) == 1 and capped[0]["hit_cap"] and capped[0]["path"] == ["A", "E", "D"]
    met = signed.convergence(arcs, spark.createDataFrame([("A",), ("X",)], "id string")).where("id = 'C'").first()
    assert met["distances"] == {"A": 2, "X": 1}


def test_annotate_responses(spark):
    arcs = spark.createDataFrame(SIGNED, "src string, dst string, status string")
    out = signed.annotate_responses(arcs, spark.createDataFrame([("D",), ("Q",)], "id string"), spark.createDataFrame([("A",)], "id string"))
    rows = {r["target"]: (r["relation"], r["path_count"]) for r in out.collect()}
    assert rows == {"D": ("indirect downstream", 2), "Q": ("unresolved", 0)}


def test_rewire_keeps_degrees(spark):
    rows = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + 1) % 40}", 1.0) for i in range(40)], "src string, dst string, weight double").where("src <> dst")
    base = edges.simplify(rows).select("src", "dst", "weight")
    out = resilience.rewire(base, 12)
    degree = lambda df: {r["id"]: r["n"] for r in df.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert degree(out) == degree(base) and edges.simplify(out).count() == base.count()
    assert out.exceptAll(base).count() > 0


def test_modularity_finds_two_cliques(spark):
    rows = [(a, b, 1.0) for group in ("abcd", "wxyz") for a in group for b in group if a < b] + [("a", "w", 0.1)]
    table = spark.createDataFrame(rows, "src string, dst string, weight double")
    found = {r["id"]: r["community"] for r in resilience.communities(table).collect()}
    assert len({found[n] for n in "abcd"}) == 1 and len({found[n] for n in "wxyz"}) == 1 and found["a"] != found["w"]


def test_degree_matched_draws(spark):
    degrees = spark.createDataFrame([(f"n{i:02d}", 4 + i % 3) for i in range(30)] + [("hub", 900)], "id string, degree bigint")
    draws = scenarios.degree_matched_draws(degrees, ["n00", "n01", "hub"], 5).collect()
    assert len(draws) == 15 and not {"n00", "n01", "hub"} & {r["id"] for r in draws}


def test_half_loss_dose(spark):
    doses = spark.createDataFrame([(0.9, 10.0), (0.5, 40.0), (0.1, 80.0)], "survival double, loss_pct double")
    got = scenarios.half_loss_dose(doses).first()
    assert got["status"] == "interpolated" and got["half_loss_survival"] == pytest.approx(0.4)
    assert scenarios.half_loss_dose(doses.where("loss_pct < 50")).first()["status"] == "resistant"


def test_directed_rank_runs_as_long_as_the_tolerance_needs(spark):
    """Damping 0.95 needs 494 rounds without acceleration."""
    rows = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("a", "d", 3.0), ("d", "c", 1.0), ("d", "d2", 1.0), ("d2", "a", 1.0)]
    arcs = spark.createDataFrame(rows, "src string, dst string, weight double")
    got = ranks(pagerank(arcs, symmetric=False, damping=0.95))
    assert {n: got[("base", n)] for n in ("a", "b", "c", "d", "d2")} == pytest.approx(power(rows, ("a", "b", "c", "d", "d2"), 0.95, rounds=3000), abs=1e-10)


def test_asymmetric_arcs_are_refused(spark):
    arcs = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0)], "src string, dst string, weight double")
    with pytest.raises(ValueError, match="symmetric"):
        pagerank(arcs)


def test_one_way_scenario_is_solved_plainly(spark):
    rows = [("a", "b", 0.5), ("b", "c", 0.8), ("a", "c", 1.0), ("c", "d", 0.2)]
    both = [(s, d, w) for a, b, w in rows for s, d in ((a, b), (b, a))]
    table = scenarios.scenario_table(spark, {"hit": ["c"]}, 0.1)
    for mode, end in (("outgoing", 0), ("incoming", 1)):
        found = {r["id"]: r["perturbed"] for r in scenarios.what_if(graph(spark, rows), table, mode=mode).collect()}
        assert found == pytest.approx(power([(s, d, w * 0.1 if (s, d)[end] == "c" else w) for s, d, w in both], "abcd", 0.85), abs=1e-9)


def test_distances_and_routes_along_a_long_path(spark):
    arcs = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}", 1.0) for k in range(24)], "src string, dst string, distance double")
    origin = spark.createDataFrame([("n00",)], "source string")
    found = traversal.shortest_distances(arcs, origin)
    assert {r["id"]: r["dist"] for r in found.collect()} == {f"n{k:02d}": float(k) for k in range(25)}
    route = traversal.shortest_routes(arcs, found, spark.createDataFrame([("n00", "n24")], "source string, id string")).first()
    assert route["path"] == [f"n{k:02d}" for k in range(25)]
    assert traversal.hop_distances(arcs, origin, max_depth=3).count() == 4


def test_rewiring_reaches_its_number_or_raises(spark):
    star = spark.createDataFrame([("hub", f"n{k}", 1.0) for k in range(6)], "src string, dst string, weight double")
    with pytest.raises(ValueError, match="0 of 2"):
        resilience.rewire(star, 2)


def test_draws_fill_a_short_band_from_the_nearest_degrees(spark):
    """Three targets of a band with one other node: every iteration still has three different nodes, none a target."""
    degrees = spark.createDataFrame([("t1", 64), ("t2", 65), ("t3", 66), ("same", 70)] + [(f"n{k}", 4 + k % 4) for k in range(20)], "id string, degree bigint")
    draws = scenarios.degree_matched_draws(degrees, ["t1", "t2", "t3", "absent"], 7).collect()
    per = {}
    for r in draws:
        per.setdefault(r["scenario_id"], []).append(r["id"])
    assert len(per) == 7 and all(len(ids) == len(set(ids)) == 3 and "same" in ids and not {"t1", "t2", "t3"} & set(ids) for ids in per.values())
    with pytest.raises(ValueError, match="fewer nodes"):
        scenarios.degree_matched_draws(degrees.where("degree >= 64 AND degree < 66"), ["t1", "t2"], 2)


def test_normal_tail_in_far_tails(spark):
    import math

    from meshflux.functions.measures import normal_tail

    rows = spark.createDataFrame([(float(z),) for z in (-9, -2, -0.5, 0, 0.3, 1, 2.8, 2.9, 4, 6, 8, 20, 35)], "z double")
    for r in rows.withColumn("p", normal_tail("z")).collect():
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)) / 2, rel=1e-11)
