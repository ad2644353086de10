"""Graphs and members of many contexts at once, and communities."""

import itertools
import random

import pytest

from meshflux.operators.edges import context_graph, context_graphs
from meshflux.operators.resilience import _moves_apart, communities, modularity
from meshflux.plans.scenarios import context_overlap


def test_overlap_equals_sets(spark):
    draw = random.Random(3)
    sets = {c: {f"n{draw.randrange(400)}" for _ in range(k)} for c, k in (("a", 300), ("b", 150), ("c", 1), ("d", 250))}
    rows = [(c, x) for c, ids in sets.items() for x in ids for _ in range(1 + len(x) % 2)] + [("a", None), (None, "n1")]
    frame = spark.createDataFrame(rows, "context string, id string").repartition(5)
    for names in (None, ["d", "c", "a", "absent"]):
        got = {(r.context_a, r.context_b): r for r in context_overlap(frame, names).collect()}
        order = sorted(sets) if names is None else names
        assert set(got) == set(itertools.combinations(order, 2))
        for (a, b), r in got.items():
            x, y = sets.get(a, set()), sets.get(b, set())
            assert (r.members_a, r.members_b, r.shared, r.union) == (len(x), len(y), len(x & y), len(x | y))
            assert abs(r.jaccard - len(x & y) / len(x | y)) < 1e-12
    assert context_overlap(frame.limit(0), ["a", "b"]).collect()[0].jaccard is None


def test_overlap_of_no_contexts(spark):
    assert context_overlap(spark.createDataFrame([], "context string, id string")).count() == 0


def test_all_graphs_equal_each(spark):
    draw = random.Random(5)
    nodes = [f"n{k}" for k in range(12)]
    edges = spark.createDataFrame([(a, b, draw.randrange(200, 1000)) for a in nodes for b in nodes if draw.random() < 0.4], "src string, dst string, score int")
    levels = spark.createDataFrame([(x, c, float(draw.randrange(0, 9))) for c in "uvw" for x in nodes for _ in range(2)], "id string, context string, level double")
    got = sorted(map(tuple, context_graphs(edges, levels, threshold=300).collect()))
    want = []
    for c in "uvw":
        want += [(c, *r) for r in context_graph(edges, levels, context=c, threshold=300, mode="comparable").collect()]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    assert all(abs(g[3] - w[3]) < 1e-12 and abs(g[4] - w[4]) < 1e-9 * w[4] for g, w in zip(got, sorted(want)))


def test_no_move_and_no_merger_raises_the_modularity(spark):
    draw = random.Random(11)
    nodes = [f"n{k:02d}" for k in range(24)]
    rows = [(a, b, float(draw.randrange(1, 9))) for a, b in itertools.combinations(nodes, 2) if draw.random() < (0.5 if int(a[1:]) // 8 == int(b[1:]) // 8 else 0.15)]
    table = spark.createDataFrame(rows, "src string, dst string, weight double")
    found = {r["id"]: r["community"] for r in communities(table).collect()}
    total = 2 * sum(w for *_, w in rows)

    def value(member):
        inside, strength = {}, {}
        for a, b, w in rows:
            for x in (a, b):
                strength[member[x]] = strength.get(member[x], 0) + w
            if member[a] == member[b]:
                inside[member[a]] = inside.get(member[a], 0) + 2 * w
        return sum(inside.get(c, 0) / total - (k / total) ** 2 for c, k in strength.items())

    best = value(found)
    assert set(found) == {x for a, b, _ in rows for x in (a, b)} and all(found[c] == c for c in found.values())
    for a, b in itertools.permutations(sorted(set(found.values())), 2):
        assert value({x: b if c == a else c for x, c in found.items()}) <= best + 1e-9
    assert modularity(table, spark.createDataFrame(list(found.items()), "id string, community string")).first()["modularity"] == pytest.approx(best, abs=1e-12)


def test_moves_apart_touch_no_community_twice(spark):
    draw = random.Random(13)
    rows = [(f"n{k}", f"c{a}", f"c{b}", draw.randrange(1, 5) / 4) for k in range(200) for a, b in [draw.sample(range(30), 2)]]
    moves = spark.createDataFrame(rows, "id string, own string, community string, rise double")
    taken = _moves_apart(moves).collect()
    ends = [c for r in taken for c in (r.own, r.community)]
    assert taken and len(ends) == len(set(ends))
    first = min(rows, key=lambda r: (-r[3], r[0]))
    assert first[0] in {r.id for r in taken}


def test_moves_made_together_raise_the_modularity_by_what_the_bound_leaves(spark):
    """Two leaves of one community and a node that would enter it: the leaves go, unless the first takes the gain of the second."""
    from meshflux.operators.resilience import _moves_together

    rows = [("a", "A", "B", 1.0, 0.5), ("b", "A", "B", 1.0, 0.4), ("c", "C", "A", 1.0, 0.3)]
    wish = spark.createDataFrame(rows, "id string, own string, community string, k double, rise double")
    assert {(r["id"], r["community"]) for r in _moves_together(wish, 10.0).collect()} == {("a", "B"), ("b", "B")}
    assert {r["id"] for r in _moves_together(wish, 4.0).collect()} == {"a"}


def test_leaves_enter_their_centres_in_one_round(spark):
    """A level of three stars ends after two rounds, the second of which only finds that no node wants to move."""
    from meshflux.operators.resilience import _local_moves
    from meshflux.operators.propagation import symmetric_arcs
    from meshflux.session import Lineage

    class Counted(Lineage):
        cuts = 0

        def cut(self, df):
            self.cuts += 1
            return super().cut(df)

    edges = spark.createDataFrame([(f"c{k}", f"l{k}_{n}", 1.0) for k in range(3) for n in range(5)], "src string, dst string, weight double")
    links = symmetric_arcs(edges)
    lineage = Counted(spark)
    found = {r["id"]: r["community"] for r in _local_moves(lineage, lineage.cut(links), 30.0).collect()}
    assert all(found[f"l{k}_{n}"] == found[f"c{k}"] for k in range(3) for n in range(5))
    assert len(set(found.values())) == 3
    assert lineage.cuts <= 12
