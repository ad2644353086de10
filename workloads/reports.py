"""Small report operators: filters, contracts, fallbacks, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshflux.functions import measures as m
from meshflux.functions import text as tx
from meshflux.operators import annotate as an
from meshflux.operators import resilience as rs
from meshflux.operators import signed as sg
from meshflux.operators.propagation import symmetric_arcs
from meshflux.plans import scenarios as p
from workloads import inputs as i
from workloads.registry import workload


@workload("filter_trace", """SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <= 2 AND o_totalprice > 150000 AND o_orderstatus = 'F' AND year(o_orderdate) >= 1994""")
def filter_trace(t):
    nodes = t.orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("layer"), (F.col("o_totalprice") > 150000).alias("is_critical"),
        (F.col("o_orderstatus") == "F").alias("is_significant"), (F.year("o_orderdate") >= 1994).alias("directed"))
    return sg.filter_trace(nodes, layer_limit=2, critical_only=True, significant_only=True, directed_only=True).select("id")


@workload("first_present", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN l_quantity WHEN l_discount > 0.05 AND l_tax <> 0 THEN l_discount ELSE l_extendedprice END AS value FROM lineitem""")
def first_present(t):
    """Null and NaN both fall through to the next column."""
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("a"),
        F.when(F.col("l_discount") > 0.05, F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount"))).alias("b"), F.col("l_extendedprice").alias("c"))
    return rows.select("l_orderkey", "l_linenumber", an.first_present("a", "b", "c").alias("value"))


@workload("first_in_group", """SELECT l_suppkey, arg_min(l_discount, l_orderkey * 10 + l_linenumber) AS first_discount FROM lineitem WHERE l_tax > 0.04 GROUP BY l_suppkey""")
def first_in_group(t):
    rows = t.lineitem.select(
        "l_suppkey", F.when(F.col("l_tax") > 0.04, F.col("l_discount")).alias("first_discount"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return an.first_in_group(rows, "l_suppkey", "first_discount", "place")


@workload("project_contract", """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_totalprice > 100000 THEN o_totalprice ELSE -1 END AS price, 'none' AS note, CAST(NULL AS BIGINT) AS rank FROM orders""")
def project_contract(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("total"))
    return an.project_contract(rows, [("id", "o_orderkey", "string"), ("price", "total", "double"), ("note", "remark", "string"), ("rank", "place", "bigint")], {"price": -1.0, "note": "none"})


SQL_MOVES = """mv AS (SELECT l_returnflag AS scenario_id, 'P' || l_partkey AS id, round(sum(l_discount - 0.05), 6) AS delta_pct FROM lineitem GROUP BY 1, 2)"""


def moves(t):
    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("scenario_id"), i.part_id().alias("id")).agg(F.round(F.sum(F.col("l_discount") - 0.05), 6).alias("delta_pct"))
    return rows.withColumn("direction", F.when(F.col("delta_pct") > 0, "gain").when(F.col("delta_pct") < 0, "loss").otherwise("unchanged"))


@workload("compensation", f"""WITH {SQL_MOVES}
SELECT scenario_id, id, delta_pct, rank, p_size AS importance FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY delta_pct DESC, id) AS rank FROM mv WHERE delta_pct > 0.05) x
LEFT JOIN part ON id = 'P' || p_partkey WHERE rank <= 25""")
def compensation(t):
    scores = t.part.select(i.part_id("p_partkey").alias("id"), F.col("p_size").alias("importance"))
    return p.compensation(moves(t), scores).select("scenario_id", "id", "delta_pct", "rank", "importance")


@workload("extremes", f"""WITH {SQL_MOVES}
SELECT scenario_id, arg_max(id, (delta_pct, id)) AS gain_id, max(delta_pct) AS gain_pct, arg_min(id, (delta_pct, id)) AS loss_id, min(delta_pct) AS loss_pct FROM mv GROUP BY 1""")
def extremes(t):
    return p.extremes(moves(t))


@workload("resolve_external", """SELECT 'P' || p_partkey AS query, CASE WHEN p_size > 25 THEN 'EXACT' WHEN p_size > 10 THEN 'EXTERNAL' ELSE 'UNRESOLVED' END AS status,
 CASE WHEN p_size > 25 THEN p_name WHEN p_size > 10 THEN 'ext ' || p_partkey END AS entity, CASE WHEN p_size > 25 THEN 'symbol' WHEN p_size > 10 THEN 'external' END AS stage FROM part""")
def resolve_external(t):
    """Ids unknown to the local table are looked up in an external one, last."""
    key = i.part_id("p_partkey")
    lookup = t.part.where("p_size > 25").select(key.alias("key"), F.lit("symbol").alias("stage"), F.col("p_name").alias("entity"))
    extra = t.part.where("p_size > 10").select(key.alias("key"), F.concat(F.lit("ext "), F.col("p_partkey").cast("string")).alias("entity"))
    return an.resolve(t.part.select(key.alias("query")), lookup, extra=extra).select("query", "status", "entity", "stage")


@workload("severity_fraction", "SELECT s.label, f AS fraction, count(*) AS orders FROM orders, (VALUES " + ", ".join(
    f"({k}, '{label}', {value!r}::DOUBLE)" for k, (label, value) in enumerate([*m.SEVERITIES.items()])) + f", ({len(m.SEVERITIES)}, 'Other', NULL)) s(k, label, f) WHERE o_orderkey % {len(m.SEVERITIES) + 1} = k GROUP BY 1, 2")
def severity_fraction(t):
    names = F.array(*[F.lit(n) for n in [*m.SEVERITIES, "Other"]])
    rows = t.orders.select(F.get(names, (F.col("o_orderkey") % (len(m.SEVERITIES) + 1)).cast("int")).alias("label"))
    return rows.select("label", m.severity_fraction("label").alias("fraction")).groupBy("label", "fraction").agg(F.count(F.lit(1)).alias("orders"))


@workload("sentinel_summary", """WITH x AS (SELECT CASE WHEN p_size <= 10 THEN 'NOT_EVALUATED' WHEN p_retailprice >= 1200 THEN 'PASS' ELSE 'FAIL' END AS r FROM part)
SELECT count(*) AS total, count(*) FILTER (WHERE r <> 'NOT_EVALUATED') AS evaluated, count(*) FILTER (WHERE r = 'PASS') AS passed,
 round(count(*) FILTER (WHERE r <> 'NOT_EVALUATED') / count(*), 9) AS coverage, round(count(*) FILTER (WHERE r = 'PASS') / count(*) FILTER (WHERE r <> 'NOT_EVALUATED'), 9) AS success_rate FROM x""")
def sentinel_summary(t):
    symbol = F.col("p_name")
    expected = t.part.select(i.part_id("p_partkey").alias("id"), symbol.alias("symbol"), F.lit(1200.0).alias("least"))
    observed = t.part.where("p_size > 10").select(i.part_id("p_partkey").alias("id"), F.col("p_retailprice").alias("importance"))
    out = an.sentinel_summary(an.sentinel_check(expected, observed, t.part.limit(0).select(i.part_id("p_partkey").alias("id"), symbol.alias("symbol"))))
    return out.select("total", "evaluated", "passed", F.round("coverage", 9).alias("coverage"), F.round("success_rate", 9).alias("success_rate"))


@workload("excluded_symbols", """SELECT DISTINCT upper(s) AS symbol FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS s FROM benchmark) WHERE len(s) < 3""")
def excluded_symbols(t):
    return tx.excluded_symbols(t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("symbol")))


SQL_RANKED = """v AS (SELECT 'P' || l_partkey AS id, round(sum(l_discount) - 1.5, 4) AS d FROM lineitem GROUP BY 1),
j AS (SELECT v.id, d, p_size::DOUBLE AS pagerank, p_retailprice AS degree, p_partkey::DOUBLE AS importance FROM v JOIN part ON v.id = 'P' || p_partkey),
k AS (SELECT *, """ + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r_{c}" for c in ("d", "pagerank", "degree", "importance")) + " FROM j)"


@workload("hop_correlations", f"""WITH {SQL_RANKED} """ + " UNION ALL ".join(
    f"SELECT '{c}' AS against, round(corr(r_d, r_{c}), 7) AS spearman FROM k" for c in ("pagerank", "degree", "importance")))
def hop_correlations(t):
    """Rank correlation of responses with three centralities."""
    responses = t.lineitem.groupBy(i.part_id().alias("id")).agg(F.round(F.sum("l_discount") - 1.5, 4).alias("delta_pct"))
    scores = t.part.select(i.part_id("p_partkey").alias("id"), F.col("p_size").alias("pagerank"), F.col("p_retailprice").alias("degree"), F.col("p_partkey").alias("importance"))
    rho = rs.hop_independence(symmetric_arcs(i.hop_graph(t)), responses, scores, "S1")[0]
    return rho.select("against", F.round("spearman", 7).alias("spearman"))
