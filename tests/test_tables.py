"""Statistics, ingest guards and selection on small tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshflux.functions import inference, measures, ordering, text
from meshflux.operators import annotate, crosswise, evidence, selection
from meshflux.schema import MissingColumns, require_columns
from meshflux.sources import ingest, stores


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.002), (4, None)], "id int, p double")
    q = {r["id"]: r["q_value"] for r in inference.benjamini_hochberg(rows, "p").collect()}
    assert q == pytest.approx({3: 0.01, 0: 0.025, 2: 0.05, 1: 0.05, 4: 1.0})


def test_ranks_match_numpy_under_ties(spark):
    values = [3.0, 1.0, 3.0, 2.0, 2.0, 2.0, 9.0]
    rows = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = {r["id"]: r["rank"] for r in ordering.ranked(rows, "v").collect()}
    want = {i: sum(o < v for o in values) + (sum(o == v for o in values) + 1) / 2 for i, v in enumerate(values)}
    assert got == pytest.approx(want)


def test_quantiles_match_numpy_with_a_hot_value(spark):
    values = [5.0] * 60 + [float(v) for v in range(40)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = ordering.quantiles(rows, "v", {"a": 0.05, "b": 0.5, "c": 0.99}).first()
    assert [got["a"], got["b"], got["c"]] == pytest.approx(list(np.percentile(values, [5, 50, 99])))


def test_hypergeometric_tail(spark):
    from math import comb

    cases = [(2, 5, 2, 2), (0, 10, 4, 3), (3, 50, 20, 7)]
    rows = spark.createDataFrame(cases, "o bigint, n bigint, m bigint, d bigint")
    for r in inference.hypergeometric_tail(rows, "o", "n", "m", "d").collect():
        want = sum(comb(r["m"], k) * comb(r["n"] - r["m"], r["d"] - k) for k in range(r["o"], min(r["m"], r["d"]) + 1)) / comb(r["n"], r["d"])
        assert r["p_value"] == pytest.approx(want)


def test_combiner_and_bonus_bounds(spark):
    row = spark.createDataFrame([(0.4, 0.7)], "a double, b double").select(measures.combine_channels(["a", "b"]).alias("c")).first()
    p, a, b = 0.041, (0.4 - 0.041) / 0.959, (0.7 - 0.041) / 0.959
    assert row["c"] == pytest.approx(p + (1 - p) * (1 - (1 - a) * (1 - b)))
    bonus = spark.createDataFrame([(0.0, 1.0), (0.5, 1.0), (1.0, 1.0)], "e double, t double").select(measures.corroboration_bonus("e", "t", strength=0.10).alias("x")).collect()
    values = [r["x"] for r in bonus]
    assert values[0] == 1.0 and all(1.0 <= v <= 1.1 for v in values)


def test_ablation_panel_is_complete():
    panel = evidence.ablation_conditions()
    assert len(panel) == 27 and len({c.name for c in panel}) == 27 and all(c.kept for c in panel)
    assert set(panel[0].kept) == set(evidence.NON_TEXT)


def test_normal_tail(spark):
    got = spark.createDataFrame([(0.0,), (1.96,), (-1.0,)], "z double").select(measures.normal_tail("z").alias("p")).collect()
    assert [r["p"] for r in got] == pytest.approx([0.5, 0.0249979, 0.8413447], abs=2e-7)


def brute_layers(rows):
    left, layer, out = dict(rows), 1, {}
    while left:
        front = [k for k, v in left.items() if not any(all(a >= b for a, b in zip(o, v)) and any(a > b for a, b in zip(o, v)) for o in left.values())]
        out.update({k: layer for k in front})
        left = {k: v for k, v in left.items() if k not in front}
        layer += 1
    return out


def test_pareto_layers_match_brute_force_over_blocks(spark):
    rows = [(f"r{i}", (float((i * 37) % 11), float((i * 17) % 13), float((i * 5) % 7))) for i in range(60)] + [("copy", (0.0, 0.0, 0.0))]
    table = spark.createDataFrame([(k, *v) for k, v in rows], "id string, a double, b double, c double")
    got = {r["id"]: r["layer"] for r in selection.pareto_layers(table, ["a", "b", "c"], block_rows=4).collect()}
    assert got == brute_layers(rows)


def test_pareto_layers_take_a_round_a_block_and_keep_missing_values(spark, monkeypatch):
    rows = [(f"r{i}", (float(i), float(i), float(i % 3))) for i in range(40)]
    table = spark.createDataFrame([(k, *v) for k, v in rows] + [("none", None, 1.0, 1.0)], "id string, a double, b double, c double")
    cuts, cut = [], selection.Lineage.cut
    monkeypatch.setattr(selection.Lineage, "cut", lambda self, df: cuts.append(1) or cut(self, df))
    got = {r["id"]: r["layer"] for r in selection.pareto_layers(table, ["a", "b", "c"], block_rows=20).collect()}
    assert got == {**brute_layers(rows), "none": 1}
    assert max(got.values()) > 10 and len(cuts) < 10


def test_engine_classes_keep_missing_apart_from_zero(spark):
    left = spark.createDataFrame([("A", 10.0), ("B", -5.0), ("C", 0.0)], "id string, delta_pct double")
    right = spark.createDataFrame([("A", 9.0), ("B", -6.0), ("D", 10.0)], "id string, delta_pct double")
    rows = {r["id"]: r for r in selection.synthesize(left, right, top_n=2).collect()}
    assert rows["A"]["finding"] == "ROBUST_CROSS_MODEL" and rows["D"]["left_response"] is None
    assert rows["C"]["finding"] == "LEFT_ONLY" and rows["D"]["finding"] == "RIGHT_ONLY"
    with pytest.raises(ValueError):
        selection.compare_complete(left, right)
    with pytest.raises(ValueError):
        selection.compare_outer(left.unionAll(left), right)


def test_regulator_file_with_unknown_relation_is_refused(spark):
    raw = spark.createDataFrame([(0, "TF", "A", "Activation", None), (1, "TF", "B", "Maybe", None)], "position int, regulator string, target string, relation string, reference string")
    mapping = spark.createDataFrame([("TF", "1"), ("A", "2")], "key string, value string")
    with pytest.raises(ingest.SourceError):
        ingest.regulator_tables(raw, mapping)
    forward, inverse, canonical = ingest.regulator_tables(raw.where("position = 0"), mapping)
    assert canonical.collect()[0]["regulator_id"] == "1" and forward.count() == inverse.count() == 1


def test_link_header_is_checked(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("protein1 protein2 score\na b 1\n")
    with pytest.raises(ingest.SourceError):
        ingest.read_links(spark, str(tmp_path / "bad.txt"))


def test_expression_levels_report(spark):
    raw = spark.createDataFrame([("ENSG1", "lung", "1.0"), ("ENSG1", "lung", "3.0"), ("ENSG2", "liver", "2"), ("x", "lung", "1")], "Gene string, Tissue string, TPM string")
    mapping = spark.createDataFrame([("ENSG1", "P1")], "key string, value string")
    levels, report = ingest.expression_levels(raw, mapping)
    assert levels.collect() == [("P1", "Lung", 3.0)]
    row = report.first()
    assert (row["source_records"], row["valid_records"], row["mapped_records"], row["unmapped_records"]) == (4, 2, 1, 1) and row["is_consistent"]


def test_missing_overlay_is_not_negative_evidence(spark):
    overlay, available = ingest.directed_overlay(spark, None)
    assert not available and overlay.count() == 0 and len(overlay.columns) == 14


def test_required_columns(spark):
    with pytest.raises(MissingColumns):
        require_columns(spark.range(1), "score")


def test_stale_edges_are_refused(spark, tmp_path):
    table = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    stores.write_edges(table, str(tmp_path / "e"), fingerprint="one")
    assert stores.read_edges(spark, str(tmp_path / "e"), fingerprint="one").count() == 1
    with pytest.raises(ValueError):
        stores.read_edges(spark, str(tmp_path / "e"), fingerprint="two")


def test_fingerprint_sees_repeats_and_values(spark):
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    mark = lambda df: stores.table_fingerprint(df).first()["fingerprint"]
    assert mark(one) == mark(one.orderBy(F.desc("k")))
    assert len({mark(one), mark(one.unionAll(one)), mark(one.withColumn("v", F.col("v") + 1))}) == 3


def test_resolution_stages(spark):
    lookup = spark.createDataFrame([("x1", "canonical", "E1"), ("foo", "symbol", "E1"), ("foo", "alias", "E9"), ("bar", "alias", "E1"), ("bar", "alias", "E2")], "key string, stage string, entity string")
    queries = spark.createDataFrame([(" X1 ",), ("FOO",), ("bar",), ("none",)], "query string")
    got = {r["query"]: (r["status"], r["entity"]) for r in annotate.resolve(queries, lookup).collect()}
    assert got == {" X1 ": ("EXACT", "E1"), "FOO": ("EXACT", "E1"), "bar": ("AMBIGUOUS", None), "none": ("UNRESOLVED", None)}


def test_mapping_classes(spark):
    rows = spark.createDataFrame([("A", "a", "ortholog_one2one", "1"), ("B", "b1", "ortholog_one2one", "1"), ("B", "b2", "ortholog_one2one", ""), ("C", "", "", None)], "symbol string, partner string, kind string, confidence string")
    got = sorted((r["symbol"], r["class"]) for r in crosswise.classify_mapping(rows).collect())
    assert got == [("A", "ONE_TO_ONE"), ("B", "ONE_TO_MANY"), ("B", "ONE_TO_MANY"), ("C", "NO_ORTHOLOG")]


def test_passages_match_brute_force(spark):
    docs = spark.createDataFrame([(1, "The kinase binds. Nothing here. A kinase and a lipid meet! A kinase and a lipid meet!")], "doc_id int, text string")
    got = text.passages(docs, "lipid transport", ["kinase"]).orderBy("rank").collect()
    assert [r["sentence"] for r in got] == ["A kinase and a lipid meet!", "The kinase binds."]


def test_terms(spark):
    rows = spark.createDataFrame([('["a b", "None", "c"]',), ("x ; y|x;  nan",), (None,)], "t string").select(text.split_terms("t").alias("t")).collect()
    assert [r["t"] for r in rows] == [["a b", "c"], ["x", "y"], []]


def test_all_registered_queries_have_unique_names():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert len(names) == len(set(names)) > 150 and set(entry.oracle_sql()) <= set(names)
