"""Congested nodes and the report of doses against enumerated paths."""

import itertools
import random

import pytest

from meshflux.plans import scenarios


def all_paths(lengths, s, t):
    """Every simple path from s to t with its length."""
    found, open_ = [], [((s,), 0.0)]
    while open_:
        path, total = open_.pop()
        if path[-1] == t:
            found.append((total, path))
            continue
        open_ += [((*path, b), total + d) for (a, b), d in lengths.items() if a == path[-1] and b not in path]
    return found


def plain_betweenness(lengths):
    nodes = sorted({a for a, _ in lengths})
    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        paths = all_paths(lengths, s, t)
        if paths:
            least = min(total for total, _ in paths)
            best = [p for total, p in paths if total == least]
            for path in best:
                for node in path[1:-1]:
                    out[node] += 1 / len(best)
    return out


def graph(seed):
    draw = random.Random(seed)
    nodes = [f"n{k}" for k in range(8)]
    return [(a, b, draw.randrange(1, 5)) for a, b in itertools.combinations(nodes, 2) if draw.random() < 0.45 or b == f"n{int(a[1:]) + 1}"]


def stretched(edges, targets, survival):
    both = [(a, b, d) for a, b, d in edges] + [(b, a, d) for a, b, d in edges]
    return {(a, b): d / survival if targets & {a, b} else float(d) for a, b, d in both}


@pytest.mark.parametrize(("seed", "top"), [(1, None), (2, 2)])
def test_congestion_equals_enumerated_paths(spark, seed, top):
    edges = graph(seed)
    frame = spark.createDataFrame([(a, b, 1.0 / d, float(d)) for a, b, d in edges], "src string, dst string, weight double, distance double")
    targets, doses = ["n2", "n5", "absent", "n2"], [0.5, 0.125]
    before = plain_betweenness(stretched(edges, set(targets), 1.0))
    want = {}
    for dose in doses:
        after = plain_betweenness(stretched(edges, set(targets), dose))
        gains = sorted((-round(after[n] - before[n], 6), n) for n in before if after[n] - before[n] > 5e-7)
        want[dose] = [(rank, n, before[n], after[n], -g) for rank, (g, n) in enumerate(gains, 1)]
    assert any(want.values())
    got = {d: [] for d in doses}
    for r in scenarios.dose_stress(frame, targets, doses=doses, top=top).orderBy("survival", "rank").collect():
        got[r.survival].append((r["rank"], r.id, r.before, r.after, r.delta))
    for dose in doses:
        assert [x[:2] for x in got[dose]] == [x[:2] for x in want[dose][:top]]
        assert all(abs(x - y) < 1e-6 for a, b in zip(got[dose], want[dose], strict=False) for x, y in zip(a[2:], b[2:], strict=True))


def test_only_nodes_near_the_seeds(spark):
    """A ring: the far side gains as the near side is avoided, but is out of reach of the seed."""
    edges = [(f"n{k}", f"n{(k + 1) % 9}", 1.0, 1.0) for k in range(9)]
    frame = spark.createDataFrame(edges, "src string, dst string, weight double, distance double")
    every = {r.id for r in scenarios.dose_stress(frame, ["n0"], doses=[0.25], top=None).collect()}
    seeds = spark.createDataFrame([("n0",), ("absent",)], "id string")
    near = {r.id for r in scenarios.dose_stress(frame, ["n0"], doses=[0.25], top=None, seeds=seeds, hops=3).collect()}
    assert every - near and near == every & {"n6", "n7", "n8", "n0", "n1", "n2", "n3"}


def test_report_of_a_graph_without_gains(spark):
    """On a path no way round exists: nothing gains, and the lengths follow the weights where none are given."""
    frame = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.25), ("c", "d", 0.25)], "src string, dst string, weight double")
    rows = scenarios.dose_report(frame, ["b"], doses=[0.9, 0.1]).orderBy("survival").collect()
    assert [r.survival for r in rows] == [0.1, 0.9] and all(r.stressed == [] and r.max_congestion == 0.0 for r in rows)
    assert [r.suppressed_edges for r in rows] == [2, 2] and rows[0].loss_pct > rows[1].loss_pct
    assert scenarios.dose_stress(frame.limit(0), ["b"], doses=[0.5]).count() == 0
