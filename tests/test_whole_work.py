"""Queries that used to run from a few sources or draws go through all of them, in turns that keep one vector."""

import pytest

from meshflux.operators import centrality, searches
from meshflux.operators.propagation import symmetric_arcs
from meshflux.session import Lineage
from meshflux.settings import PRESET_ITERATIONS
from workloads import scenarios as queries
from workloads import signed
from workloads.registry import Tables


class Stop(Exception):
    pass


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(p, p % 3, 40.0) for p in range(12)], "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, "TYPE") for p in range(12)], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(s, 0) for s in range(3)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    return Tables(spark, str(tmp_path))


def stopped(monkeypatch, module, name):
    asked = []

    def stop(*args, **options):
        asked.append(options)
        raise Stop

    monkeypatch.setattr(module, name, stop)
    return asked


@pytest.mark.parametrize("query", [signed.bottlenecks, signed.congestion])
def test_every_node_is_a_source(monkeypatch, tables, query):
    asked = stopped(monkeypatch, centrality, "betweenness")
    with pytest.raises(Stop):
        query(tables)
    assert asked[0].get("sample") is None and asked[0].get("sources") is None


def test_null_model_draws_the_standard_number(monkeypatch, spark, tables):
    empty = spark.createDataFrame([], "scenario_id string, id string, abs_delta double")
    monkeypatch.setattr(queries.p, "what_if", lambda *args, **options: empty)
    asked = stopped(monkeypatch, queries.p, "null_p_values")
    with pytest.raises(Stop):
        queries.null_p_values(tables)
    assert asked[0]["iterations"] == PRESET_ITERATIONS["standard"] == 99


def test_all_sources_of_a_path_in_turns(spark, monkeypatch):
    """Six sources, two a turn, and no joins of a row for each pair of nodes."""
    monkeypatch.setattr(searches, "VALUES_PER_TASK", 12)
    monkeypatch.setattr(searches, "MOST_TURNS", 1)
    monkeypatch.setattr(centrality, "_joined_dependencies", None)
    arcs = Lineage(spark).cut(symmetric_arcs(spark.createDataFrame([(f"n{k}", f"n{k + 1}", 1.0 + k) for k in range(5)], "src string, dst string, distance double"), "distance"))
    got = {r["id"]: r["betweenness"] for r in centrality.betweenness(arcs).collect()}
    assert got == pytest.approx({f"n{k}": float(k * (5 - k)) for k in range(6)})
