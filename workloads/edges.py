"""Scans, filters, weights and edge summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshflux.functions import measures as m
from meshflux.operators import edges as e
from meshflux.operators.propagation import symmetric_arcs
from meshflux.sources import tables as s
from workloads import inputs as i
from workloads.registry import workload

CONTEXT = "NATION_7"


@workload("edge_scan", f"WITH {i.SQL_PAIRS} SELECT src, dst, score FROM pairs WHERE score >= 500")
def edge_scan(t):
    return s.edge_scan(i.interactions(t), 500)


@workload("context_scan", f"""WITH {i.SQL_LEVELS}
SELECT id, max(level) AS level FROM levels WHERE context = '{CONTEXT}' AND level > 0 GROUP BY id""")
def context_scan(t):
    return s.context_scan(i.levels(t), CONTEXT)


@workload("entity_profile", f"""WITH {i.SQL_LEVELS}
SELECT context, max(level) AS level FROM levels WHERE id = 'S1' AND level > 0 GROUP BY context""")
def entity_profile(t):
    return s.entity_profile(i.levels(t), "S1")


@workload("prefix_normalisation", """
SELECT p_partkey AS key, p_partkey || '.' || p_brand AS id, count(*) AS n
FROM part GROUP BY 1, 2""")
def prefix_normalisation(t):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "9606.").otherwise("10090."),
                   F.col("p_partkey").cast("string"), F.lit("."), F.col("p_brand"))
    return t.part.select(F.col("p_partkey").alias("key"), s.strip_prefix(raw).alias("id")).groupBy("key", "id").agg(
        F.count(F.lit(1)).alias("n"))


@workload("canonical_targets", """
SELECT min(pos) AS position, id FROM (
  SELECT pos, CASE WHEN raw IN (SELECT 'P' || p_partkey FROM part) THEN raw
                   WHEN regexp_replace(raw, '^9606\\.', '') IN (SELECT 'P' || p_partkey FROM part)
                   THEN regexp_replace(raw, '^9606\\.', '') END AS id
  FROM (VALUES (0, '9606.P3'), (1, 'P5'), (2, 'P3'), (3, '10090.PX'), (4, '9606.P9')) v(pos, raw))
WHERE id IS NOT NULL GROUP BY id""")
def canonical_targets(t):
    available = t.part.select(i.part_id("p_partkey").alias("id"))
    return s.canonical_targets(["9606.P3", "P5", "P3", "10090.PX", "9606.P9"], available).select("position", "id")


@workload("keep_in_context", f"""WITH {i.SQL_PAIRS}, {i.SQL_LEVELS},
members AS (SELECT DISTINCT id FROM levels WHERE context = '{CONTEXT}' AND level > 0)
SELECT src, dst, score FROM pairs WHERE score >= 300
AND src IN (SELECT id FROM members) AND dst IN (SELECT id FROM members)""")
def keep_in_context(t):
    return e.keep_in_context(s.edge_scan(i.interactions(t), 300), s.context_scan(i.levels(t), CONTEXT))


@workload("attach_levels", f"""WITH {i.SQL_PAIRS}, {i.SQL_LEVELS},
members AS (SELECT id, max(level) AS level FROM levels WHERE context = '{CONTEXT}' GROUP BY id)
SELECT src, dst, score, coalesce(a.level, 1.0) AS level_src, coalesce(b.level, 1.0) AS level_dst
FROM pairs LEFT JOIN members a ON src = a.id LEFT JOIN members b ON dst = b.id WHERE score >= 300""")
def attach_levels(t):
    return e.attach_levels(s.edge_scan(i.interactions(t), 300), s.context_scan(i.levels(t), CONTEXT))


@workload("weigh_edges", f"""WITH {i.sql_context_edges(CONTEXT)}
SELECT src, dst, round(weight, 8) AS weight, round(1.0 / weight, 6) AS distance FROM edges""")
def weigh_edges(t):
    graph = e.context_graph(i.interactions(t), i.levels(t), context=CONTEXT, threshold=300)
    return graph.select("src", "dst", F.round("weight", 8).alias("weight"), F.round("distance", 6).alias("distance"))


@workload("comparable_weights", f"""WITH {i.SQL_PAIRS}, {i.SQL_LEVELS},
tally AS (SELECT ln(1 + level) AS v, count(*) AS n FROM levels WHERE level > 0 GROUP BY 1),
cum AS (SELECT v, sum(n) OVER (ORDER BY v) AS c, sum(n) OVER () AS total FROM tally),
q AS (SELECT min(v) FILTER (WHERE c >= 0.01 * total) AS q01, min(v) FILTER (WHERE c >= 0.99 * total) AS q99 FROM cum),
members AS (SELECT id, max(level) AS level FROM levels WHERE context = '{CONTEXT}' GROUP BY id)
SELECT src, dst, round(pow(score / 1000.0::DOUBLE, 2) * (0.1 + 0.9 * sqrt(
   greatest(0, least(1, (ln(1 + a.level) - q01) / (q99 - q01))) *
   greatest(0, least(1, (ln(1 + b.level) - q01) / (q99 - q01))))), 7) AS weight
FROM pairs JOIN members a ON src = a.id JOIN members b ON dst = b.id, q WHERE score >= 300""")
def comparable_weights(t):
    graph = e.context_graph(i.interactions(t), i.levels(t), context=CONTEXT, threshold=300, mode="comparable")
    return graph.select("src", "dst", F.round("weight", 7).alias("weight"))


@workload("strength_to_distance", """
SELECT l_orderkey, l_linenumber, l_discount,
  CASE WHEN l_discount > 0 THEN round(1.0 / l_discount, 6) ELSE -1.0 END AS distance FROM lineitem""")
def strength_to_distance(t):
    d = m.strength_to_distance("l_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_discount",
                             F.when(d == float("inf"), -1.0).otherwise(F.round(d, 6)).alias("distance"))


@workload("mask_unreachable", """
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0 THEN 1.0 / l_discount END AS distance FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
  round(coalesce(distance, (SELECT 2 * max(distance) FROM d)), 6) AS distance FROM d""")
def mask_unreachable(t):
    edges = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", m.strength_to_distance("l_discount").alias("distance"))
    return e.mask_unreachable(edges).withColumn("distance", F.round("distance", 6))


@workload("simplify", """
SELECT least(a, b) AS src, greatest(a, b) AS dst, max(w) AS weight, min(d) AS distance, bool_or(f) AS is_bridge FROM (
  SELECT l_partkey % 97 AS a, l_suppkey % 97 AS b, l_quantity AS w, l_extendedprice AS d, l_returnflag = 'R' AS f FROM lineitem)
WHERE a <> b GROUP BY 1, 2""")
def simplify(t):
    return e.simplify(t.lineitem.select(
        (F.col("l_partkey") % 97).alias("src"), (F.col("l_suppkey") % 97).alias("dst"), F.col("l_quantity").alias("weight"),
        F.col("l_extendedprice").alias("distance"), (F.col("l_returnflag") == "R").alias("is_bridge")))


@workload("degree_rows", """
SELECT id, count(*) AS degree, max(score) AS max_score FROM (
  SELECT 'P' || l_partkey AS id, l_quantity AS score FROM lineitem UNION ALL SELECT 'S' || l_suppkey, l_quantity FROM lineitem)
GROUP BY id""")
def degree_rows(t):
    raw = t.lineitem.select(i.part_id().alias("src"), i.supplier_id().alias("dst"), F.col("l_quantity").alias("score"))
    return e.degree_summary(raw, distinct=False)


@workload("degree_partners", """
SELECT id, count(DISTINCT other) AS degree, max(score) AS max_score FROM (
  SELECT 'P' || l_partkey AS id, 'S' || l_suppkey AS other, l_quantity AS score FROM lineitem
  UNION ALL SELECT 'S' || l_suppkey, 'P' || l_partkey, l_quantity FROM lineitem)
GROUP BY id""")
def degree_partners(t):
    raw = t.lineitem.select(i.part_id().alias("src"), i.supplier_id().alias("dst"), F.col("l_quantity").alias("score"))
    return e.degree_summary(raw)


@workload("category_traffic", f"""WITH {i.sql_edges()}, {i.SQL_LOCATIONS}
SELECT least(a.location, b.location) AS location_a, greatest(a.location, b.location) AS location_b,
  count(*) AS edges, least(a.location, b.location) = greatest(a.location, b.location) AS is_internal
FROM edges JOIN locations a ON src = a.id JOIN locations b ON dst = b.id GROUP BY 1, 2""")
def category_traffic(t):
    return e.category_traffic(i.plain_graph(t), i.part_locations(t))


@workload("traffic_matrix", f"""WITH {i.sql_edges()}, {i.SQL_LOCATIONS},
c AS (SELECT a.location AS x, b.location AS y FROM edges JOIN locations a ON src = a.id JOIN locations b ON dst = b.id),
u AS (SELECT x, y FROM c UNION ALL SELECT y, x FROM c WHERE x <> y)
SELECT x AS location_a, count(*) FILTER (WHERE y = 'AFRICA') AS "AFRICA", count(*) FILTER (WHERE y = 'ASIA') AS "ASIA",
  count(*) FILTER (WHERE y = 'ECONOMY') AS "ECONOMY" FROM u GROUP BY x HAVING count(*) FILTER (WHERE y IN ('AFRICA','ASIA','ECONOMY')) >= 0""")
def traffic_matrix(t):
    return e.traffic_matrix(e.category_traffic(i.plain_graph(t), i.part_locations(t)), ["AFRICA", "ASIA", "ECONOMY"])


@workload("contingency", """
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS "O", count(*) FILTER (WHERE l_linestatus = 'F') AS "F"
FROM lineitem GROUP BY l_returnflag""")
def contingency(t):
    return e.contingency(t.lineitem, "l_returnflag", "l_linestatus", ["O", "F"])


@workload("neighbour_shares", f"""WITH {i.sql_edges()}, {i.SQL_LOCATIONS},
seen AS (SELECT a.src, a.weight, l.location AS own, r.location AS theirs FROM arcs a JOIN locations l ON a.src = l.id JOIN locations r ON a.dst = r.id),
part_w AS (SELECT src, theirs, sum(weight) AS w FROM seen GROUP BY 1, 2),
top AS (SELECT src, theirs, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, theirs) AS r FROM part_w),
txt AS (SELECT src, string_agg(theirs, ', ' ORDER BY r) AS neighbour_labels FROM top WHERE r <= 3 GROUP BY src)
SELECT s.src AS id, round(sum(CASE WHEN own = theirs THEN 0 ELSE weight END) / sum(weight), 6) AS external_ratio, any_value(neighbour_labels) AS neighbour_labels
FROM seen s JOIN txt USING (src) GROUP BY s.src""")
def neighbour_shares(t):
    out = e.neighbour_shares(symmetric_arcs(i.plain_graph(t)), i.part_locations(t))
    names = F.regexp_replace("neighbour_labels", r":[0-9.]+", "")
    return out.withColumns({"external_ratio": F.round("external_ratio", 6), "neighbour_labels": names})


@workload("suppress_targets", f"""WITH {i.sql_edges()}
SELECT src, dst, round(w, 9) AS weight, round(1.0 / w, 4) AS distance FROM (
  SELECT src, dst, CASE WHEN src IN ('P1', 'P2') OR dst IN ('S1') THEN weight * 0.05 ELSE weight END AS w FROM edges)""")
def suppress_targets(t):
    targets = t.spark.createDataFrame([("P1",), ("P2",), ("S1",)], "id string")
    out = e.suppressed(i.plain_graph(t), targets, 0.05)
    return out.select("src", "dst", F.round("weight", 9).alias("weight"), F.round("distance", 4).alias("distance"))


@workload("forced_distance_cap", f"""WITH {i.sql_edges()}
SELECT src, dst, round(CASE WHEN src = 'P1' OR dst = 'S1' THEN least(distance, (SELECT 1.5 * avg(distance) FROM edges)) ELSE distance END, 6) AS distance
FROM edges""")
def forced_distance_cap(t):
    targets = t.spark.createDataFrame([("P1",), ("S1",)], "id string")
    out = e.cap_forced_distances(i.plain_graph(t), targets)
    return out.select("src", "dst", F.round("distance", 6).alias("distance"))


@workload("edge_modifiers", f"""WITH {i.sql_edges()},
f AS (
  SELECT e.src, e.dst, 1.2 AS factor FROM edges e WHERE e.dst = 'S1' AND e.src IN (SELECT 'P' || l_partkey FROM lineitem WHERE l_suppkey = 1 AND l_returnflag = 'R')
  UNION ALL
  SELECT e.src, e.dst, 1.2 FROM edges e JOIN part p ON e.src = 'P' || p_partkey JOIN supplier s ON e.dst = 'S' || s_suppkey
  WHERE e.dst = 'S1' AND p_size % 5 = s_nationkey % 5
  UNION ALL
  SELECT e.src, e.dst, 0.7 FROM edges e JOIN part p ON e.src = 'P' || p_partkey JOIN supplier s ON e.dst = 'S' || s_suppkey
  WHERE e.dst = 'S1' AND p_size % 3 = s_nationkey % 3),
g AS (SELECT src, dst, product(factor) AS factor FROM f GROUP BY 1, 2)
SELECT e.src, e.dst, round(weight * coalesce(factor, 1), 8) AS weight FROM edges e LEFT JOIN g USING (src, dst)""")
def edge_modifiers(t):
    graph = i.plain_graph(t)
    targets = t.spark.createDataFrame([("S1",)], "id string")
    regulated = t.lineitem.where("l_returnflag = 'R'").select(i.supplier_id().alias("regulator"), i.part_id().alias("id"))
    def labels(mod, name):
        return t.part.select(i.part_id("p_partkey").alias("id"), (F.col("p_size") % mod).cast("string").alias(name)).unionByName(
            t.supplier.select(i.supplier_id("s_suppkey").alias("id"), (F.col("s_nationkey") % mod).cast("string").alias(name)))
    factors = e.bonus_factors(graph, targets, regulated, labels(5, "group")).unionByName(
        e.penalty_factors(graph, targets, labels(3, "class")))
    return e.apply_factors(graph, factors).select("src", "dst", F.round("weight", 8).alias("weight"))
