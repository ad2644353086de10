"""Ranks, adjusted p-values, enrichment, overlaps and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshflux.functions import inference as inf
from meshflux.functions import measures as m
from meshflux.functions import ordering as o
from meshflux.operators import scores as sc
from meshflux.session import cut
from workloads import inputs as i
from workloads.registry import workload


def r(name, digits):
    return F.round(name, digits).alias(name)


@workload("average_ranks", """SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal, -3))
 + (count(*) OVER (PARTITION BY c_nationkey, round(c_acctbal, -3)) - 1) / 2.0 AS rank FROM customer""")
def average_ranks(t):
    rows = t.customer.withColumn("v", F.round("c_acctbal", -3))
    return o.ranked(rows, "v", by=["c_nationkey"]).select("c_custkey", "c_nationkey", "rank")


@workload("competition_ranks", """WITH x AS (SELECT 'P' || l_partkey AS id, round(sum(l_discount - 0.05), 4) AS delta_pct FROM lineitem GROUP BY 1),
a AS (SELECT id, rank() OVER (ORDER BY abs(delta_pct) DESC) AS absolute_rank, count(*) OVER () AS n FROM x),
p AS (SELECT id, rank() OVER (ORDER BY delta_pct DESC) AS positive_rank FROM x WHERE delta_pct > 0),
g AS (SELECT id, rank() OVER (ORDER BY delta_pct) AS negative_rank FROM x WHERE delta_pct < 0)
SELECT a.id, absolute_rank, positive_rank, negative_rank, round(1 - (absolute_rank - 1) / (n - 1)::DOUBLE, 8) AS absolute_rank_percentile FROM a LEFT JOIN p USING (id) LEFT JOIN g USING (id)""")
def competition_ranks(t):
    rows = t.lineitem.groupBy(i.part_id().alias("id")).agg(F.round(F.sum(F.col("l_discount") - 0.05), 4).alias("delta_pct"))
    rows = rows.withColumn("delta_pct", F.col("delta_pct") + F.lit(0.0))
    return sc.response_ranks(rows).select("id", "absolute_rank", "positive_rank", "negative_rank", r("absolute_rank_percentile", 8))


@workload("row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def row_numbers(t):
    return o.row_numbers(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], name="place").select("o_orderkey", "place")


@workload("deciles", """SELECT o_orderkey, CAST(greatest(1, ceil((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 10 / (count(*) OVER () - 1)::DOUBLE)) AS INT) AS decile FROM orders""")
def deciles(t):
    return o.quantile_bins(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 10, name="decile").select("o_orderkey", "decile")


@workload("top_fraction", """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= ceil(count(*) OVER () * 0.05) AS is_top FROM orders""")
def top_fraction(t):
    return o.top_fraction(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 0.05, name="is_top").select("o_orderkey", "is_top")


@workload("exact_quantiles", """SELECT c_mktsegment, count(*) AS n, round(quantile_cont(c_acctbal, 0.05), 6) AS p05, round(quantile_cont(c_acctbal, 0.5), 6) AS p50, round(quantile_cont(c_acctbal, 0.99), 6) AS p99 FROM customer GROUP BY 1""")
def exact_quantiles(t):
    return o.quantiles(t.customer, "c_acctbal", {"p05": 0.05, "p50": 0.5, "p99": 0.99}, by=["c_mktsegment"]).select("c_mktsegment", "n", r("p05", 6), r("p50", 6), r("p99", 6))


@workload("weighted_quantiles", """WITH v AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT v, sum(n) OVER (ORDER BY v) AS c, sum(n) OVER () AS t FROM v)
SELECT min(v) FILTER (WHERE c >= 0.01 * t) AS q01, min(v) FILTER (WHERE c >= 0.99 * t) AS q99 FROM c""")
def weighted_quantiles(t):
    rows = t.lineitem.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return o.weighted_quantiles(rows, "l_quantity", "n", {"q01": 0.01, "q99": 0.99})


@workload("benjamini_hochberg", """WITH x AS (SELECT s_suppkey, s_nationkey % 3 AS family, (s_acctbal + 1000) / 12000 AS p FROM supplier),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS rk, count(*) OVER (PARTITION BY family) AS n FROM x)
SELECT s_suppkey, family, round(least(1, min(p * n / rk) OVER (PARTITION BY family ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 9) AS q_value FROM k""")
def benjamini_hochberg(t):
    rows = t.supplier.select("s_suppkey", (F.col("s_nationkey") % 3).alias("family"), ((F.col("s_acctbal") + 1000) / 12000).alias("p"))
    return inf.benjamini_hochberg(rows, "p", by=["family"]).select("s_suppkey", "family", r("q_value", 9))


@workload("correlations", """WITH x AS (SELECT c_mktsegment AS g, c_acctbal AS a, c_custkey % 100 AS b FROM customer),
k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2.0 AS rb FROM x)
SELECT g, count(*) AS n, round(corr(ra, rb), 8) AS spearman, round(corr(a, b), 8) AS pearson FROM k GROUP BY g""")
def correlations(t):
    rows = t.customer.select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 100).alias("b"))
    return inf.correlations(rows, "a", "b", by=["g"]).select("g", "n", r("spearman", 8), r("pearson", 8))


SQL_ORA = """sel AS (SELECT DISTINCT 'P' || l_partkey AS id FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.09),
bg AS (SELECT 'P' || p_partkey AS id FROM part WHERE p_size <= 45), d AS (SELECT id FROM sel WHERE id IN (SELECT id FROM bg)),
mb AS (SELECT p_type AS library, p_brand AS term, 'P' || p_partkey AS id FROM part), sz AS (SELECT count(*) AS n FROM bg), dr AS (SELECT count(*) AS k FROM d),
ts AS (SELECT library, term, count(*) AS set_size, count(*) FILTER (WHERE id IN (SELECT id FROM d)) AS matched FROM mb WHERE id IN (SELECT id FROM bg) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE id IN (SELECT id FROM d)) > 0),
pv AS (SELECT library, term, set_size, matched, (SELECT sum(exp(lgamma(set_size + 1) - lgamma(j + 1) - lgamma(set_size - j + 1) + lgamma(n - set_size + 1) - lgamma(k - j + 1) - lgamma(n - set_size - k + j + 1)
   - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1))) FROM (SELECT unnest(range(matched, least(set_size, k) + 1)) AS j) WHERE k - j <= n - set_size) AS p_value FROM ts, sz, dr)"""


@workload("over_representation", f"""WITH {SQL_ORA}, k AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY p_value) AS rk, count(*) OVER (PARTITION BY library) AS m FROM pv)
SELECT library, term, matched, set_size, round(p_value, 7) AS p_value, round(least(1, min(p_value * m / rk) OVER (PARTITION BY library ORDER BY p_value DESC, rk DESC ROWS UNBOUNDED PRECEDING)), 7) AS q_value FROM k""")
def over_representation(t):
    selected = t.lineitem.where("l_quantity >= 49 AND l_discount >= 0.09").select(i.part_id().alias("id"))
    background = t.part.where("p_size <= 45").select(i.part_id("p_partkey").alias("id"))
    members = t.part.select(F.col("p_type").alias("library"), F.col("p_brand").alias("term"), i.part_id("p_partkey").alias("id"))
    out = inf.over_representation(selected, background, members, top=None)
    return out.select("library", "term", "matched", "set_size", r("p_value", 7), r("q_value", 7))


@workload("overlap_members", f"WITH {SQL_ORA} SELECT library, term, id FROM mb WHERE id IN (SELECT id FROM d)")
def overlap_members(t):
    selected = t.lineitem.where("l_quantity >= 49 AND l_discount >= 0.09").select(i.part_id().alias("id"))
    background = t.part.where("p_size <= 45").select(i.part_id("p_partkey").alias("id"))
    members = t.part.select(F.col("p_type").alias("library"), F.col("p_brand").alias("term"), i.part_id("p_partkey").alias("id"))
    return inf.overlap_members(selected, background, members)


@workload("concordance", """WITH u AS (SELECT p_partkey AS id FROM part), a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_discount >= 0.1), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_tax >= 0.08),
c AS (SELECT (SELECT count(*) FROM u) AS n, (SELECT count(*) FROM a) AS p, (SELECT count(*) FROM b) AS q, (SELECT count(*) FROM a JOIN b USING (id)) AS x)
SELECT n AS universe, p AS predicted, q AS reference, x AS intersection, round(x / p, 8) AS precision_like, round(x / q, 8) AS recall_like, round(x / (p + q - x), 8) AS jaccard,
 round((SELECT sum(exp(lgamma(q + 1) - lgamma(j + 1) - lgamma(q - j + 1) + lgamma(n - q + 1) - lgamma(p - j + 1) - lgamma(n - q - p + j + 1) - lgamma(n + 1) + lgamma(p + 1) + lgamma(n - p + 1)))
   FROM (SELECT unnest(range(greatest(x, p + q - n), least(p, q) + 1)) AS j)), 6) AS p_value FROM c""")
def concordance(t):
    ids = lambda df, c: df.select(F.col(c).alias("id"))
    out = inf.concordance(ids(t.lineitem.where("l_discount >= 0.1"), "l_partkey"), ids(t.lineitem.where("l_tax >= 0.08"), "l_partkey"), ids(t.part, "p_partkey"))
    return out.select("universe", "predicted", "reference", "intersection", r("precision_like", 8), r("recall_like", 8), r("jaccard", 8), r("p_value", 6))


@workload("set_overlap", """WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_discount >= 0.1), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_tax >= 0.08)
SELECT (SELECT count(*) FROM a) AS left_count, (SELECT count(*) FROM b) AS right_count, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS intersection, count(*) AS "union",
 round(count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) / count(*), 8) AS jaccard FROM a FULL JOIN b ON a.id = b.id""")
def set_overlap(t):
    ids = lambda c: t.lineitem.where(c).select(F.col("l_partkey").alias("id"))
    return inf.set_overlap(ids("l_discount >= 0.1"), ids("l_tax >= 0.08")).select("left_count", "right_count", "intersection", "union", r("jaccard", 8))


@workload("recall_at", """WITH ord AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents), ref AS (SELECT doc_id AS id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 20000)), n AS (SELECT count(*) AS n FROM ref)
SELECT k, count(*) AS returned, count(ref.id) AS overlap, round(count(ref.id) / any_value(n), 8) AS recall, round(count(*) * any_value(n) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS expected
FROM (SELECT unnest([50, 100, 200]) AS k) ks JOIN ord ON pos <= k LEFT JOIN ref ON ref.id = ord.id, n GROUP BY k""")
def recall_at(t):
    ordered = o.row_numbers(t.documents.select(F.col("doc_id").alias("id"), "n_chars"), [F.desc("n_chars"), F.asc("id")], name="position")
    reference = t.labels.where("quality = 1").select(F.col("doc_id").alias("id"))
    perturbed = t.documents.where("n_chars > 20000").select(F.col("doc_id").alias("id"))
    out = inf.recall_at(ordered, reference, [50, 100, 200], perturbed=perturbed, population=t.documents.count())
    return out.select("k", "returned", "overlap", r("recall", 8), r("expected", 6))


@workload("rank_shift_summary", """WITH x AS (SELECT rank() OVER (ORDER BY p_retailprice) AS a, rank() OVER (ORDER BY p_size) AS b FROM part)
SELECT quantile_cont(abs(a - b), 0.5) AS median_abs_shift, round(quantile_cont(abs(a - b), 0.95), 6) AS p95_abs_shift, max(abs(a - b))::DOUBLE AS max_abs_shift FROM x""")
def rank_shift_summary(t):
    rows = cut(t.part.select("p_partkey", "p_retailprice", "p_size"))
    rows = o.ranked(o.ranked(rows, "p_retailprice", name="a", method="min"), "p_size", name="b", method="min")
    return inf.rank_shift_summary(rows, "a", "b").withColumn("p95_abs_shift", F.round("p95_abs_shift", 6))


@workload("quartile_groups", """WITH x AS (SELECT 'P' || l_partkey AS id, round(sum(l_discount) - 1.5, 4) AS d, sum(l_quantity) AS s FROM lineitem GROUP BY 1),
q AS (SELECT quantile_cont(d, 0.75) AS d75, quantile_cont(abs(d), 0.5) AS a50, quantile_cont(s, 0.5) AS s50, quantile_cont(s, 0.75) AS s75 FROM x)
(SELECT id, 'sensitive_not_central' AS "group" FROM x, q WHERE d >= d75 AND s <= s50 ORDER BY d DESC, id LIMIT 10)
UNION ALL (SELECT id, 'central_but_weak' FROM x, q WHERE s >= s75 AND abs(d) <= a50 ORDER BY s DESC, id LIMIT 10)""")
def quartile_groups(t):
    rows = t.lineitem.groupBy(i.part_id().alias("id")).agg(F.round(F.sum("l_discount") - 1.5, 4).alias("delta_pct"), F.sum("l_quantity").alias("importance"))
    return sc.quartile_groups(rows).select("id", "group")


@workload("scalar_measures", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - pow(1 - l_discount * 10, 2) / (0.25 + pow(1 - l_discount * 10, 2))), 4) AS hill,
 round(0.1::DOUBLE * pow(1 - l_discount * 10, 2) / (0.25 + pow(1 - l_discount * 10, 2)), 9) AS boost,
 CASE WHEN l_discount - l_tax > 0 THEN 'gain' WHEN l_discount - l_tax < 0 THEN 'loss' ELSE 'no change' END AS direction,
 CASE WHEN l_tax <> 0 THEN round((l_discount - l_tax) / l_tax * 100, 6) ELSE 0 END AS change,
 CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'conflicting_evidence' WHEN l_returnflag = 'R' THEN 'consensus_stimulation' WHEN l_linestatus = 'O' THEN 'consensus_inhibition' WHEN l_returnflag = 'A' THEN 'direction_only' ELSE 'unsupported_direction' END AS status,
 CASE WHEN abs(l_discount - 0.05) <= 1e-12 THEN 'Strong' ELSE 'Custom' END AS severity, l_returnflag IN ('1', 'yes') AS truth,
 CASE WHEN l_returnflag = 'R' AND l_linestatus <> 'O' THEN 1 WHEN l_returnflag <> 'R' AND l_linestatus = 'O' THEN -1 ELSE 0 END AS sign FROM lineitem""")
def scalar_measures(t):
    up, down = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    left = F.col("l_discount") * 10
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(m.hill_survival("l_extendedprice", left), 4).alias("hill"), F.round(m.neighbour_boost(left), 9).alias("boost"),
        m.direction(F.col("l_discount") - F.col("l_tax")).alias("direction"), F.round(m.percent_change("l_tax", "l_discount"), 6).alias("change"),
        m.evidence_status(up, down, F.col("l_returnflag") == "A").alias("status"), m.severity_name("l_discount").alias("severity"),
        m.strict_true("l_returnflag").alias("truth"), m.canonical_sign(up, down).cast("int").alias("sign"))


@workload("confidence_labels", """WITH x AS (SELECT c_custkey, c_acctbal > 0 AS d, c_nationkey > 5 AS b, c_nationkey % 6 AS a, c_custkey % 3 AS e FROM customer),
s AS (SELECT c_custkey, round(least(0.95, 0.2 + CASE WHEN d THEN 0.3 ELSE 0 END + CASE WHEN b THEN 0.2 ELSE 0 END + least(0.2, a * 0.05) + least(0.1, e * 0.05)), 4) AS score FROM x)
SELECT c_custkey, score::DOUBLE AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS label FROM s""")
def confidence_labels(t):
    score = F.round(m.confidence_score(F.col("c_acctbal") > 0, F.col("c_nationkey") > 5, F.col("c_nationkey") % 6, (F.col("c_custkey") % 3).cast("int")), 4)
    return t.customer.select("c_custkey", score.alias("score"), m.confidence_label(score).alias("label"))


@workload("normal_tail", """WITH m AS (SELECT avg(c_acctbal) AS mean, stddev_pop(c_acctbal) AS std FROM customer),
z AS (SELECT c_custkey, (c_acctbal - mean) / std * 4.0::DOUBLE AS z FROM customer, m), x AS (SELECT c_custkey, z, abs(z) / sqrt(2.0::DOUBLE) AS x FROM z),
t AS (SELECT c_custkey, z, CASE WHEN x <= 2 THEN 0.5::DOUBLE - (SELECT sum(pow(-1.0::DOUBLE, k) * pow(x, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))) FROM range(0, 40) r(k)) / sqrt(pi())
 ELSE exp(-x * x) / sqrt(pi()) / 2 / list_reduce(range(120, 0, -1)::DOUBLE[], lambda f, k: x + k / (f * 2.0::DOUBLE), x) END AS h FROM x)
SELECT c_custkey, round(ln(CASE WHEN z >= 0 THEN h ELSE 1 - h END), 8) AS log_p FROM t""")
def normal_tail(t):
    """Logarithm of the upper normal tail of standardised balances, stretched to reach far tails."""
    spread = t.customer.agg(F.avg("c_acctbal").alias("mean"), F.stddev_pop("c_acctbal").alias("std"))
    z = (F.col("c_acctbal") - F.col("mean")) / F.col("std") * 4.0
    return t.customer.join(F.broadcast(spread)).select("c_custkey", F.round(F.log(m.normal_tail(z)), 8).alias("log_p"))  # one row
