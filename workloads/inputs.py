"""Network-shaped inputs derived from the sales tables, in Spark and in SQL.

An edge joins a part and a supplier that were sold together; the context is the
nation of the buyer. Part ids carry ``P``, supplier ids ``S``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workloads.registry import Tables



def part_id(column: str = "l_partkey"):
    return F.concat(F.lit("P"), F.col(column).cast("string"))


def supplier_id(column: str = "l_suppkey"):
    return F.concat(F.lit("S"), F.col(column).cast("string"))


def interactions(t: Tables) -> DataFrame:
    """Scored part-supplier pairs: ten points per sold unit, at most 1000."""
    pairs = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return pairs.select(
        part_id().alias("src"), supplier_id().alias("dst"),
        F.least(F.lit(1000), F.col("q") * 10).cast("int").alias("score"),
    )


def levels(t: Tables) -> DataFrame:
    """Largest quantity of every part and supplier per buyer nation."""
    sold = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    ends = F.array(part_id(), supplier_id())
    return sold.select(F.explode(ends).alias("id"), F.col("n_name").alias("context"), F.col("l_quantity").alias("level"))


def part_locations(t: Tables) -> DataFrame:
    """Location labels: part type for parts, nation's region for suppliers."""
    parts = t.part.select(part_id("p_partkey").alias("id"), F.col("p_type").alias("location"))
    suppliers = (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(supplier_id("s_suppkey").alias("id"), F.col("r_name").alias("location"))
    )
    return parts.unionByName(suppliers)


def plain_graph(t: Tables, threshold: int = 300) -> DataFrame:
    """Weighted undirected edges over all contexts."""
    return interactions(t).where(F.col("score") >= threshold).select(
        "src", "dst", "score", F.pow(F.col("score") / 1000.0, F.lit(2.0)).alias("weight"),
        (1.0 / F.pow(F.col("score") / 1000.0, F.lit(2.0))).alias("distance"),
    )


def hop_graph(t: Tables) -> DataFrame:
    """All pairs with whole-number distances, so path lengths tie exactly."""
    return interactions(t).select(
        "src", "dst", "score", (F.lit(1001) - F.col("score")).cast("double").alias("distance"),
        (F.lit(1.0) / (F.lit(1001) - F.col("score"))).alias("weight"),
    )


def purchases(t: Tables) -> DataFrame:
    """Orders linked to their customers: a graph of many components."""
    return t.orders.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("dst"))


SQL_PURCHASES = "buys AS (SELECT 'O' || o_orderkey AS src, 'C' || o_custkey AS dst FROM orders)"


def baskets(t: Tables) -> DataFrame:
    """Parts that share an order, with the number of shared orders."""
    a = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("a")).distinct()
    b = a.withColumnRenamed("a", "b")
    return a.join(b, "l_orderkey").where("a < b").groupBy(part_id("a").alias("src"), part_id("b").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


SQL_BASKETS = """li AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
bk AS MATERIALIZED (SELECT 'P' || a.l_partkey AS src, 'P' || b.l_partkey AS dst, count(*)::DOUBLE AS weight FROM li a JOIN li b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey GROUP BY 1, 2),
ba AS MATERIALIZED (SELECT src, dst, weight FROM bk UNION ALL SELECT dst, src, weight FROM bk)"""

SQL_PAIRS = """pairs AS (
  SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst,
         CAST(least(1000, sum(l_quantity) * 10) AS INTEGER) AS score
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""

SQL_LEVELS = """levels AS (
  SELECT u.id AS id, n_name AS context, l_quantity AS level
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey,
  LATERAL (SELECT unnest(['P' || l_partkey, 'S' || l_suppkey]) AS id) u)"""

SQL_LOCATIONS = """locations AS (
  SELECT 'P' || p_partkey AS id, p_type AS location FROM part
  UNION ALL
  SELECT 'S' || s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def sql_edges(threshold: int = 300) -> str:
    return f"""{SQL_PAIRS}, edges AS (
  SELECT src, dst, score, pow(score / 1000.0::DOUBLE, 2) AS weight,
         1.0 / pow(score / 1000.0::DOUBLE, 2) AS distance
  FROM pairs WHERE score >= {threshold}),
arcs AS MATERIALIZED (SELECT src, dst, weight, distance FROM edges UNION ALL SELECT dst, src, weight, distance FROM edges)"""


def sql_context_edges(context: str, threshold: int = 300) -> str:
    """Weighted edges of one context with within-context scaling."""
    return f"""{SQL_PAIRS}, {SQL_LEVELS},
members AS (SELECT id, max(level) AS level FROM levels WHERE context = '{context}' AND level > 0 GROUP BY id),
raw AS (
  SELECT p.src, p.dst, p.score, sqrt(greatest(a.level, 0.01) * greatest(b.level, 0.01)) AS r
  FROM pairs p JOIN members a ON p.src = a.id JOIN members b ON p.dst = b.id WHERE p.score >= {threshold}),
span AS (SELECT min(r) AS lo, max(r) AS hi FROM raw),
edges AS MATERIALIZED (
  SELECT src, dst, score,
         greatest(pow(score / 1000.0::DOUBLE, 2)
           * CASE WHEN hi > lo THEN 0.1::DOUBLE + 0.9::DOUBLE * ((r - lo) / (hi - lo)) ELSE 1.0::DOUBLE END,
           1e-9::DOUBLE) AS weight
  FROM raw, span),
arcs AS MATERIALIZED (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"""


def sql_pagerank(name: str, arcs: str, *, damping: float = 0.85, rounds: int = 220) -> str:
    """CTEs ending in ``name(id, pagerank)``: plain power iteration on ``arcs``."""
    return f"""
{name}_s AS MATERIALIZED (SELECT src AS id, sum(weight) AS s FROM {arcs} GROUP BY src),
{name}_n AS MATERIALIZED (SELECT count(*) AS n FROM (SELECT src FROM {arcs} UNION SELECT dst FROM {arcs})),
{name}_q AS MATERIALIZED (SELECT a.src, a.dst, a.weight / s.s AS q FROM {arcs} a JOIN {name}_s s ON a.src = s.id),
{name}_i AS (
  SELECT id, 1.0::DOUBLE / n AS x, 0 AS k FROM {name}_s, {name}_n
  UNION ALL
  SELECT q.dst, {1.0 - damping!r}::DOUBLE / max(n.n) + {damping!r}::DOUBLE * sum(q.q * i.x), max(i.k) + 1
  FROM {name}_i i JOIN {name}_q q ON i.id = q.src CROSS JOIN {name}_n n WHERE i.k < {rounds} GROUP BY q.dst),
{name} AS MATERIALIZED (SELECT id, x AS pagerank FROM {name}_i WHERE k = {rounds})"""


def sql_keyed_walk(name: str, arcs: str, rounds: int = 220) -> str:
    """CTEs ending in ``name(context, id, pagerank)``: the power iteration in every context."""
    return f"""
{name}_s AS MATERIALIZED (SELECT context, src AS id, sum(weight) AS s FROM {arcs} GROUP BY 1, 2),
{name}_n AS MATERIALIZED (SELECT context, count(*) AS n FROM {name}_s GROUP BY 1),
{name}_q AS MATERIALIZED (SELECT a.context, a.src, a.dst, a.weight / s.s AS q FROM {arcs} a JOIN {name}_s s ON a.src = s.id AND a.context = s.context),
{name}_i AS (SELECT context, id, 1.0::DOUBLE / n AS x, 0 AS k FROM {name}_s JOIN {name}_n USING (context) UNION ALL
  SELECT q.context, q.dst, 0.15::DOUBLE / max(n.n) + 0.85::DOUBLE * sum(q.q * i.x), max(i.k) + 1
  FROM {name}_i i JOIN {name}_q q ON i.id = q.src AND i.context = q.context JOIN {name}_n n ON n.context = q.context WHERE i.k < {rounds} GROUP BY q.context, q.dst),
{name} AS MATERIALIZED (SELECT context, id, x AS pagerank FROM {name}_i WHERE k = {rounds})"""


def sql_responses() -> str:
    """CTEs from ``arcs`` and ``sc(sid, ids, factor)``: arcs ``ar`` and ranks ``kw`` of every scenario, in ``context``, and the responses ``resp``."""
    return f"""
ar AS MATERIALIZED (SELECT 'base' AS context, src, dst, weight FROM arcs UNION ALL
  SELECT sid, src, dst, CASE WHEN list_contains(ids, src) OR list_contains(ids, dst) THEN weight * factor ELSE weight END FROM arcs, sc),
{sql_keyed_walk('kw', 'ar')},
resp AS MATERIALIZED (SELECT y.context AS scenario_id, id, y.pagerank - x.pagerank AS delta, (y.pagerank - x.pagerank) / x.pagerank * 100 AS delta_pct
  FROM kw x JOIN kw y USING (id) WHERE x.context = 'base' AND y.context <> 'base')"""


def sql_shift(responses: str) -> str:
    return f"""shift AS MATERIALIZED (SELECT scenario_id, sum(abs(delta)) / 2 AS total_variation, 100.0 * avg(CASE WHEN abs(delta) > 1e-6 THEN 1 ELSE 0 END) AS moved_pct,
  25 * sum(abs(delta)) + 50.0 * avg(CASE WHEN abs(delta) > 1e-6 THEN 1 ELSE 0 END) AS system_shift_pct FROM {responses} GROUP BY 1)"""


def sql_efficiencies(sources: tuple[str, ...], rounds: int = 30) -> str:
    """CTEs from ``ar`` ending in ``ef(context, e)``: efficiency from the sources over distances 1 / weight."""
    values = ", ".join(f"('{s}')" for s in sources)
    return f"""
ef_r AS (SELECT context, s AS source, s AS id, 0.0::DOUBLE AS dist, 0 AS k FROM (VALUES {values}) v(s), (SELECT DISTINCT context FROM ar) c
  UNION ALL SELECT context, source, id, min(dist), k + 1 FROM (
    SELECT context, source, id, dist, k FROM ef_r UNION ALL SELECT r.context, source, a.dst, r.dist + 1 / a.weight, r.k FROM ef_r r JOIN ar a ON r.id = a.src AND r.context = a.context) u
  WHERE k < {rounds} GROUP BY context, source, id, k),
ef AS MATERIALIZED (SELECT context, sum(CASE WHEN dist > 0 THEN 1 / dist END) / ({len(sources)} * ((SELECT count(DISTINCT src) FROM arcs) - 1)) AS e FROM ef_r WHERE k = {rounds} GROUP BY 1)"""
