"""Searches on blocks of arcs against the same by joins."""

import random

import pytest

from meshflux.operators import centrality, searches, traversal
from meshflux.session import Lineage


def keyed(spark, seed=3):
    draw = random.Random(seed)
    rows = [(key, f"n{draw.randrange(30)}", f"n{draw.randrange(30)}", float(draw.randrange(4))) for key in "ab" for _ in range(70)]
    rows += [("a", "n1", None, 2.0), ("a", None, "n2", 1.0), (None, "n1", "n2", 1.0), ("b", "n1", "n2", None), rows[0]]
    arcs = spark.createDataFrame(rows, "k string, src string, dst string, distance double")
    sources = spark.createDataFrame([(k, s) for k in "ab" for s in ("n1", "n5", "far")] + [("a", "n7"), ("a", None), (None, "n1")], "k string, source string")
    return Lineage(spark).cut(arcs), Lineage(spark).cut(sources)


def test_distances_on_blocks_match_joins(spark, monkeypatch):
    monkeypatch.setattr(searches.blocks, "ARCS_WORTH_A_TASK", 20)
    arcs, sources = keyed(spark)
    plain = sorted(map(str, traversal._relax(arcs, sources, ["k"], None).collect()))
    monkeypatch.setattr(traversal, "_relax", None)  # the joins send all arcs in every round
    assert sorted(map(str, traversal.shortest_distances(arcs, sources, by=["k"]).collect())) == plain


def test_dependencies_on_blocks_match_joins(spark, monkeypatch):
    monkeypatch.setattr(searches.blocks, "ARCS_WORTH_A_TASK", 20)
    arcs, sources = keyed(spark)
    lineage = Lineage(spark)
    got = {(r["k"], r["id"]): r["value"] for r in centrality._dependencies(lineage, arcs, sources, ["k"]).collect() if r["value"]}
    plain = {(r["k"], r["id"]): r["value"] for r in centrality._joined_dependencies(lineage, arcs, sources, ["k"]).collect() if r["value"]}
    assert len(plain) > 10 and got == pytest.approx(plain)
