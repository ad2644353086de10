"""Communities, rewiring, sweeps, knock-outs and rescue."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshflux.operators import resilience as rs
from meshflux.operators import edges as e
from meshflux.operators.centrality import betweenness
from meshflux.operators.propagation import symmetric_arcs
from meshflux.session import cut
from workloads import inputs as i
from workloads.registry import workload


def r(name, digits):
    return F.round(name, digits).alias(name)


def sparse(t):
    return cut(i.plain_graph(t).select("src", "dst", "weight", "distance"))


@workload("communities", f"""WITH {i.sql_edges()} SELECT count(DISTINCT src) AS nodes, count(DISTINCT src) AS labelled, true AS named_by_member, true AS better_than_none FROM arcs""")
def communities(t):
    """Labels are not unique: every node has one, a label is a member's id, and the modularity beats one community and single nodes."""
    graph = sparse(t)
    member = cut(rs.communities(graph))
    nodes = e.degree_summary(graph.withColumn("score", F.lit(0))).select("id")
    held = nodes.join(member.withColumnRenamed("id", "member"), nodes["id"] == F.col("member"), "left").agg(
        F.count(F.lit(1)).alias("nodes"), F.countDistinct("member").alias("labelled"))
    named = member.groupBy("community").agg((F.min("id") == F.col("community")).alias("ok")).agg(F.bool_and("ok").alias("named_by_member"))
    better = rs.modularity(graph, member).select((F.col("modularity") > 0).alias("better_than_none"))
    return held.join(F.broadcast(named)).join(F.broadcast(better))  # one row each


@workload("modularity", f"""WITH {i.sql_edges()}, {i.SQL_LOCATIONS},
x AS (SELECT a.weight AS w, l.location AS c, m.location AS d FROM arcs a JOIN locations l ON a.src = l.id JOIN locations m ON a.dst = m.id), t AS (SELECT sum(w) AS m2 FROM x),
g AS (SELECT c, sum(CASE WHEN c = d THEN w ELSE 0 END) AS i, sum(w) AS k FROM x GROUP BY c)
SELECT round(sum(i / m2 - (k / m2) * (k / m2)), 9) AS modularity, count(*) AS communities FROM g, t""")
def modularity(t):
    member = i.part_locations(t).select("id", F.col("location").alias("community"))
    return rs.modularity(i.plain_graph(t), member).select(r("modularity", 9), "communities")


@workload("rewire", f"""WITH {i.SQL_PAIRS}, e AS (SELECT src, dst FROM pairs WHERE score >= 300),
d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT id, degree, true AS moved, 0 AS loops, 0 AS doubles FROM d""")
def rewire(t):
    """Degrees stay; at least as many edges as exchanges are new; no loop and no double edge."""
    graph = sparse(t)
    out = cut(rs.rewire(graph, 60))
    pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    new = out.select(*pair).join(graph.select(*pair), ["src", "dst"], "left_anti").agg((F.count(F.lit(1)) >= 60).alias("moved"))
    loops = out.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    doubles = out.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("doubles"))
    flags = new.join(loops).join(doubles)  # one row each
    return e.degree_summary(out.withColumn("score", F.lit(0))).select("id", "degree").join(F.broadcast(flags))  # one row


@workload("top_set_stability", None)
def top_set_stability(t):
    return rs.top_set_stability(i.plain_graph(t))


@workload("null_betweenness", None)
def null_betweenness(t):
    graph = sparse(t)
    seen = cut(betweenness(symmetric_arcs(graph, "distance"), sample=6))
    return rs.null_betweenness(graph, seen.orderBy(F.desc("betweenness"), "id").limit(20), iterations=3, sample=6)


SQL_SWEEP = f"""WITH RECURSIVE {i.SQL_PAIRS}, th AS (SELECT unnest([600, 700, 800, 900]) AS threshold),
ed AS MATERIALIZED (SELECT threshold, src, dst FROM pairs, th WHERE score >= threshold),
ar AS MATERIALIZED (SELECT threshold, src, dst FROM ed UNION ALL SELECT threshold, dst, src FROM ed),
c AS (SELECT threshold, src AS id, src AS label, 0 AS k FROM ar GROUP BY threshold, src
  UNION ALL SELECT threshold, id, min(label), k + 1 FROM (SELECT * FROM c UNION ALL SELECT c.threshold, a.dst, c.label, c.k FROM c JOIN ar a ON c.id = a.src AND c.threshold = a.threshold) u WHERE k < 50 GROUP BY threshold, id, k),
s AS (SELECT threshold, label, count(*) AS n FROM c WHERE k = 50 GROUP BY 1, 2),
g AS (SELECT threshold, sum(n) AS nodes, max(n) AS largest FROM s GROUP BY 1), m AS (SELECT threshold, count(*) AS edges FROM ed GROUP BY 1)
SELECT threshold, nodes, edges, round(largest / nodes, 7) AS largest_ratio, round(2.0::DOUBLE * edges / nodes, 7) AS mean_degree,
 round(largest / nodes * sqrt(2.0::DOUBLE * edges / nodes / ln(nodes + 1)), 7) AS resilience FROM g JOIN m USING (threshold)"""


@workload("threshold_sweep", SQL_SWEEP)
def threshold_sweep(t):
    out = rs.threshold_sweep(i.interactions(t), (600, 700, 800, 900))
    return out.select("threshold", "nodes", "edges", r("largest_ratio", 7), r("mean_degree", 7), r("resilience", 7))


@workload("threshold_sweep_hubs", None)
def threshold_sweep_hubs(t):
    return rs.threshold_sweep(i.interactions(t), (500, 700), full=True)


SQL_KNOCK = f"""WITH RECURSIVE {i.SQL_PAIRS}, ed AS MATERIALIZED (SELECT src, dst FROM pairs WHERE score >= 300),
nd AS MATERIALIZED (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) GROUP BY id),
rm AS (SELECT 'hub:' || id AS k, id FROM (SELECT id FROM nd ORDER BY degree DESC, id LIMIT 4) UNION ALL SELECT 'random', id FROM (SELECT id FROM nd ORDER BY md5(id) LIMIT 4)),
ks AS (SELECT 'none' AS k UNION SELECT k FROM rm),
al AS MATERIALIZED (SELECT ks.k AS removal, nd.id FROM nd, ks WHERE (ks.k, nd.id) NOT IN (SELECT (k, id) FROM rm)),
ar AS MATERIALIZED (SELECT a.removal, s AS src, d AS dst FROM (SELECT src AS s, dst AS d FROM ed UNION ALL SELECT dst, src FROM ed) x JOIN al a ON a.id = s JOIN al b ON b.id = d AND b.removal = a.removal),
c AS (SELECT removal, id, id AS label, 0 AS n FROM al
  UNION ALL SELECT removal, id, min(label), n + 1 FROM (SELECT * FROM c UNION ALL SELECT c.removal, a.dst, c.label, c.n FROM c JOIN ar a ON c.id = a.src AND c.removal = a.removal) u WHERE n < 16 GROUP BY removal, id, n),
z AS (SELECT removal, max(m) AS largest FROM (SELECT removal, label, count(*) AS m FROM c WHERE n = 16 GROUP BY 1, 2) GROUP BY 1)
SELECT removal, round((w.largest - z.largest) / w.largest * 100, 6) AS drop_pct FROM z, (SELECT largest FROM z WHERE removal = 'none') w WHERE removal <> 'none'"""


@workload("knockout", SQL_KNOCK)
def knockout(t):
    graph = sparse(t)
    scores = e.degree_summary(graph.withColumn("score", F.lit(0))).select("id", F.col("degree").alias("betweenness"))
    control = scores.orderBy(F.md5(F.col("id").cast("binary"))).limit(4).select("id")
    return rs.knockout(graph, scores, top=4, control=control).select("removal", r("drop_pct", 6))


@workload("rescue", f"""WITH {i.SQL_PAIRS}, g AS (SELECT src, dst FROM pairs WHERE score >= 500), n AS (SELECT src AS id FROM g UNION SELECT dst FROM g),
w AS (SELECT unnest(['P1', 'P2', 'P3', 'P4', 'P5', 'P6', 'Z1', 'A2']) AS id), ab AS (SELECT id FROM w WHERE id NOT IN (SELECT id FROM n)),
o AS (SELECT src, dst, score, CASE WHEN score >= 500 THEN 500 WHEN score >= 450 THEN 450 WHEN score >= 400 THEN 400 WHEN score >= 350 THEN 350 WHEN score >= 300 THEN 300 WHEN score >= 250 THEN 250 WHEN score >= 200 THEN 200 END AS step
  FROM pairs WHERE src IN (SELECT id FROM ab)),
b AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY step DESC, score DESC, dst) AS k FROM o WHERE step IS NOT NULL)
, j AS (SELECT src, dst FROM g UNION SELECT src, dst FROM b WHERE k = 1),
h AS (SELECT id FROM (SELECT src AS id, dst AS other FROM j UNION SELECT dst, src FROM j) GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)
SELECT src, dst, round(pow(score / 1000.0::DOUBLE, 2), 9) AS weight, false AS is_bridge FROM b WHERE k = 1
UNION ALL SELECT least(ab.id, h.id), greatest(ab.id, h.id), 0.25::DOUBLE, true FROM ab, h WHERE ab.id NOT IN (SELECT src FROM b)""")
def rescue(t):
    """Partners of absent parts, which join the one component, and bridges to its best-connected node for ids that nothing links."""
    graph = i.plain_graph(t, 500)
    out = rs.rescue(i.interactions(t), graph, ["P1", "P2", "P3", "P4", "P5", "P6", "Z1", "A2"], threshold=500)
    return out.select("src", "dst", r("weight", 9), "is_bridge")


def sql_placed(name):
    return f"""p{name} AS MATERIALIZED (SELECT id, round(pagerank, 12) AS value, row_number() OVER (ORDER BY round(pagerank, 12) DESC, id) AS place,
 rank() OVER (ORDER BY round(pagerank, 12)) + (count(*) OVER (PARTITION BY round(pagerank, 12)) - 1) / 2.0::DOUBLE AS tied FROM d{name})"""


DAMPINGS = {75: 0.75, 85: 0.85, 95: 0.95}


@workload("damping_robustness", f"""WITH RECURSIVE {i.sql_edges()},
{",".join(i.sql_pagerank(f"d{k}", "arcs", damping=d, rounds=int(620 if k == 95 else 220)) for k, d in DAMPINGS.items())}, {", ".join(map(sql_placed, DAMPINGS))},
j AS ({" UNION ALL ".join(f"SELECT {d!r}::DOUBLE AS damping, x.place, r.place AS ref, x.tied, r.tied AS ref_tied, abs(x.place - r.place) AS shift FROM p{k} x JOIN p85 r USING (id)" for k, d in DAMPINGS.items())}),
s AS (SELECT damping, corr(tied, ref_tied) AS rho, count(*) FILTER (WHERE place <= 100 AND ref <= 100) / count(*) FILTER (WHERE place <= 100 OR ref <= 100) AS jac FROM j GROUP BY 1),
w AS (SELECT min(rho) AS r, min(jac) AS j FROM s)
SELECT damping, round(rho, 4) AS spearman, CASE WHEN r >= 0.95 AND j >= 0.75 THEN 'Stable' WHEN r >= 0.85 AND j >= 0.5 THEN 'Moderately Sensitive' ELSE 'Sensitive' END AS classification FROM s, w""")
def damping_robustness(t):
    """Shifts of places are left to the tests: places of near equal values differ between two solvers."""
    return rs.damping_robustness(i.plain_graph(t)).select("damping", r("spearman", 4), "classification")


@workload("sampling_check", None)
def sampling_check(t):
    return rs.sampling_check(symmetric_arcs(i.plain_graph(t, 500), "distance"), sample=16, reference=64, top=30)


@workload("hop_buckets", f"""WITH RECURSIVE {i.SQL_PAIRS}, ed AS (SELECT src, dst FROM pairs), ar AS MATERIALIZED (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed),
h AS (SELECT 'S1' AS id, 0 AS k UNION SELECT a.dst, h.k + 1 FROM h JOIN ar a ON h.id = a.src WHERE h.k < 3), hp AS (SELECT id, min(k) AS hop FROM h GROUP BY id),
b AS (SELECT 'P' || l_partkey AS id, round(sum(l_discount) - 1.5, 4) AS v FROM lineitem GROUP BY 1 ORDER BY abs(v) DESC, id LIMIT 100)
SELECT CASE WHEN hop IS NULL THEN '4+ or unreachable' ELSE hop || ' hop' END AS bucket, count(*) AS responses FROM b LEFT JOIN hp USING (id) GROUP BY 1""")
def hop_buckets(t):
    responses = t.lineitem.groupBy(i.part_id().alias("id")).agg(F.round(F.sum("l_discount") - 1.5, 4).alias("delta_pct"))
    scores = t.part.select(i.part_id("p_partkey").alias("id"), F.col("p_size").alias("pagerank"), F.col("p_retailprice").alias("degree"), F.col("p_partkey").alias("importance"))
    return rs.hop_independence(symmetric_arcs(i.hop_graph(t)), responses, scores, "S1")[1]
