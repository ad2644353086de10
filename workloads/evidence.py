"""Evidence channels and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshflux.functions import measures as m
from meshflux.operators import audits as au
from meshflux.operators import evidence as ev
from meshflux.session import cut
from workloads import inputs as i
from workloads.registry import workload

# Channel columns made from the sales of a part-supplier pair, in file order.
CHANNEL_SQL = {
    "neighborhood": "40 * count_n",
    "neighborhood_transferred": "25 * count_a",
    "fusion": "60 * count_r",
    "cooccurence": "15 * lines",
    "homology": "100 * count_n",
    "coexpression": "6 * open_q",
    "coexpression_transferred": "5 * done_q",
    "experiments": "5000 * disc",
    "experiments_transferred": "4000 * tax",
    "database": "9 * ret_q",
    "database_transferred": "7 * acc_q",
    "textmining": "10 * qty",
    "textmining_transferred": "3 * qty",
}


def channel_rows(t):
    rows = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "N").alias("count_n"), F.count_if(F.col("l_returnflag") == "A").alias("count_a"),
        F.count_if(F.col("l_returnflag") == "R").alias("count_r"), F.sum("l_linenumber").alias("lines"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)).alias("open_q"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0)).alias("done_q"),
        F.round(F.sum("l_discount"), 4).alias("disc"), F.round(F.sum("l_tax"), 4).alias("tax"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("ret_q"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0)).alias("acc_q"), F.sum("l_quantity").alias("qty"))
    return rows.select(
        i.part_id().alias("src"), i.supplier_id().alias("dst"), F.lit(1).alias("line_no"),
        *[F.least(F.lit(1000), F.round(F.expr(e))).cast("int").alias(c) for c, e in CHANNEL_SQL.items()],
        F.least(F.lit(1000), F.round(F.expr("200 + 12 * qty"))).cast("int").alias("combined_score"))


def with_decoys(t):
    """Every pair twice: an earlier row the other way round with other values, which must lose, and the true one."""
    rows = channel_rows(t).withColumn("line_no", F.lit(2))
    decoys = rows.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("line_no"), *[(F.lit(1000) - F.col(c)).alias(c) for c in ev.CHANNELS], F.lit(999).alias("combined_score"))
    return decoys.where(F.col("src").isNotNull()).join(rows.where("combined_score >= 600").select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").unionByName(rows)


def sql_combine(channels):
    product = " * ".join(f"(CASE WHEN {c} > 0 THEN 1 - greatest(0, ({c} / 1000.0::DOUBLE - 0.041::DOUBLE) / 0.959::DOUBLE) ELSE 1 END)" for c in channels)
    return f"(0.041::DOUBLE + 0.959::DOUBLE * (1 - {product}))"


SQL_CHANNELS = f"""agg AS (
  SELECT l_partkey, l_suppkey, count(*) FILTER (WHERE l_returnflag = 'N') AS count_n, count(*) FILTER (WHERE l_returnflag = 'A') AS count_a,
   count(*) FILTER (WHERE l_returnflag = 'R') AS count_r, sum(l_linenumber) AS lines,
   sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS open_q, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS done_q,
   round(sum(l_discount), 4) AS disc, round(sum(l_tax), 4) AS tax,
   sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS ret_q, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS acc_q,
   sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
ch AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst,
  {", ".join(f"CAST(least(1000, round({e})) AS INTEGER) AS {c}" for c, e in CHANNEL_SQL.items())},
  CAST(least(1000, round(200 + 12 * qty)) AS INTEGER) AS combined_score FROM agg),
idx AS MATERIALIZED (SELECT *, {sql_combine(ev.COMBINED)} AS reconstructed, {sql_combine(ev.NON_TEXT)} AS s_nontext,
  greatest(0, (combined_score / 1000.0::DOUBLE - {sql_combine(ev.NON_TEXT)}) / (combined_score / 1000.0::DOUBLE)) AS text_dependency
  FROM ch WHERE combined_score >= 600),
edges AS (SELECT src, dst, combined_score, pow(combined_score / 1000.0::DOUBLE, 2) * 0.5::DOUBLE AS weight FROM idx)"""


def index(t):
    return ev.channel_index(channel_rows(t), threshold=600)


def graph(t):
    scored = F.pow(F.col("combined_score") / 1000.0, F.lit(2.0)) * F.lit(0.5)
    return channel_rows(t).where("combined_score >= 600").select("src", "dst", scored.alias("weight"))


def r(name, digits):
    return F.round(name, digits).alias(name)


@workload("channel_index", f"""WITH {SQL_CHANNELS}
SELECT src, dst, combined_score, round(reconstructed, 8) AS reconstructed, round(s_nontext, 8) AS s_nontext, round(text_dependency, 8) AS text_dependency FROM idx""")
def channel_index(t):
    return ev.channel_index(with_decoys(t), threshold=600).select(
        "src", "dst", "combined_score", r("reconstructed", 8), r("s_nontext", 8), r("text_dependency", 8))


@workload("index_quality", f"""WITH {SQL_CHANNELS},
x AS (SELECT combined_score / 1000.0::DOUBLE AS a, round(reconstructed, 12) AS b, abs(round(reconstructed, 12) - combined_score / 1000.0::DOUBLE) AS e FROM idx),
k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x)
SELECT count(*) AS n, round(corr(ra, rb), 7) AS spearman, round(corr(a, b), 7) AS pearson, round(quantile_cont(e, 0.5), 8) AS median_error,
 round(quantile_cont(e, 0.95), 8) AS p95_error, round(quantile_cont(e, 0.99), 8) AS p99_error, round(max(e), 8) AS max_error FROM k""")
def index_quality(t):
    out = ev.index_quality(index(t).withColumn("reconstructed", F.round("reconstructed", 12)))
    return out.select("n", r("spearman", 7), r("pearson", 7), *[r(c, 8) for c in ("median_error", "p95_error", "p99_error", "max_error")])


@workload("profiles_for_edges", f"WITH {SQL_CHANNELS} SELECT e.src, e.dst, round(weight, 8) AS weight, database, textmining FROM edges e JOIN idx USING (src, dst)")
def profiles_for_edges(t):
    flipped = graph(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    out = ev.profiles_for(flipped, index(t))
    return out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), r("weight", 8), "database", "textmining")


HILL = "pow({x}, 2) / (pow(0.6::DOUBLE, 2) + pow({x}, 2))"


def sql_bonus(gate):
    ht, he = HILL.format(x="tx"), HILL.format(x="s_nontext")
    formula = {"G1": f"({ht}) * ({he})", "G2": f"({ht}) * sqrt({he})", "G3": f"({ht}) * (2 * ({he}) / (1 + ({he})))"}[gate]
    return f"(1 + 0.05::DOUBLE * {formula})"


SQL_TEXT = f"tx AS (SELECT src, dst, s_nontext, combined_score, {sql_combine(('textmining', 'textmining_transferred'))} AS tx FROM idx)"


@workload("evidence_weights", f"""WITH {SQL_CHANNELS}, {SQL_TEXT}
SELECT src, dst, round(s_nontext * s_nontext * 0.5::DOUBLE * {sql_bonus('G1')}, 8) AS weight, round({sql_bonus('G1')}, 8) AS text_bonus FROM tx""")
def evidence_weights(t):
    return ev.reweigh(ev.profiles_for(graph(t), index(t))).select("src", "dst", r("weight", 8), r("text_bonus", 8))


@workload("evidence_topology", f"""WITH {SQL_CHANNELS}, {SQL_TEXT}
SELECT src, dst, round(s_nontext * s_nontext * 0.5::DOUBLE * {sql_bonus('G3')}, 8) AS weight FROM tx WHERE s_nontext * 1000 >= 700""")
def evidence_topology(t):
    out = ev.reweigh(ev.profiles_for(graph(t), index(t)), gate="G3", topology_threshold=700)
    return out.select("src", "dst", r("weight", 8))


@workload("gate_family", f"""WITH {SQL_CHANNELS}, {SQL_TEXT}
SELECT src, dst, round({sql_bonus('G1')}, 9) AS g1, round({sql_bonus('G2')}, 9) AS g2, round({sql_bonus('G3')}, 9) AS g3 FROM tx""")
def gate_family(t):
    text = ev.recombined(("textmining", "textmining_transferred"))
    return index(t).select("src", "dst", *[F.round(m.corroboration_bonus("s_nontext", text, gate=g), 9).alias(g.lower()) for g in ("G1", "G2", "G3")])


SQL_ABLATED = f"""ab AS MATERIALIZED ({" UNION ALL ".join(f"SELECT src, dst, '{c.name}' AS condition, {sql_combine(c.kept)} AS confidence FROM idx" for c in ev.ablation_conditions())})"""


@workload("ablation_panel", f"""WITH {SQL_CHANNELS}, {SQL_ABLATED}
SELECT condition, src, dst, round(confidence, 8) AS confidence, round(greatest(confidence * confidence * 0.5::DOUBLE, 1e-9::DOUBLE), 8) AS weight FROM ab""")
def ablation_panel(t):
    return ev.ablate(ev.profiles_for(graph(t), index(t))).select("condition", "src", "dst", r("confidence", 8), r("weight", 8))


@workload("ablation_health", f"""WITH {SQL_CHANNELS}, {SQL_ABLATED}
SELECT condition, count(*) AS edges, round(quantile_cont(confidence, 0.5), 7) AS score_median, round(quantile_cont(confidence, 0.05), 7) AS score_p5,
 round(quantile_cont(confidence, 0.95), 7) AS score_p95, round(avg(CASE WHEN confidence < 0.05 THEN 1 ELSE 0 END), 7) AS near_zero FROM ab GROUP BY condition""")
def ablation_health(t):
    out = ev.ablation_health(ev.ablate(ev.profiles_for(graph(t), index(t))))
    return out.select("condition", "edges", *[r(c, 7) for c in ("score_median", "score_p5", "score_p95", "near_zero")])


SQL_ENDS = f"""{SQL_TEXT}, w AS (SELECT idx.*, {sql_bonus('G1')} AS text_bonus,
 {" + ".join(f"CAST({c} > 0 AS INT)" for c in ev.COMBINED)} AS channels FROM idx JOIN (SELECT src, dst, tx FROM tx) USING (src, dst)),
ends AS (SELECT * EXCLUDE (src, dst), u.id FROM w, LATERAL (SELECT unnest([src, dst]) AS id) u)"""


@workload("node_evidence", f"""WITH {SQL_CHANNELS}, {SQL_ENDS}
SELECT id, round(avg(text_bonus), 8) AS text_modifier, median(channels) AS annotation_availability, round(quantile_cont(s_nontext, 0.5), 8) AS non_text_evidence,
 round(quantile_cont(text_dependency, 0.5), 8) AS text_dependency, 0 AS physical_supported, 0.0 AS physical_coverage FROM ends GROUP BY id""")
def node_evidence(t):
    out = ev.node_evidence(ev.reweigh(ev.profiles_for(graph(t), index(t))))
    return out.select("id", r("text_modifier", 8), "annotation_availability", r("non_text_evidence", 8), r("text_dependency", 8), "physical_supported", "physical_coverage")


@workload("node_audit", f"""WITH {SQL_CHANNELS}, {SQL_ENDS},
g AS (SELECT 'P' || l_partkey AS id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT e.id, count(*) AS incident_edges, round(avg(s_nontext), 8) AS mean_s_nontext, round(avg(s_nontext / (combined_score / 1000.0::DOUBLE)), 8) AS mean_ratio,
 round(avg(channels), 8) AS mean_channels, round(avg(CASE WHEN experiments > 0 OR experiments_transferred > 0 THEN 1 ELSE 0 END), 8) AS experimental_share,
 round(avg(CASE WHEN database > 0 OR database_transferred > 0 THEN 1 ELSE 0 END), 8) AS database_share, median(combined_score) / 1000.0 AS median_published,
 round(quantile_cont(s_nontext, 0.5), 8) AS median_s_nontext, coalesce(any_value(g.n), 0) AS memberships FROM ends e LEFT JOIN g ON g.id = e.id GROUP BY e.id""")
def node_audit(t):
    groups = t.lineitem.select(i.part_id().alias("id"), F.col("l_orderkey").alias("group"))
    out = ev.node_audit(ev.profiles_for(graph(t), index(t)), groups)
    return out.select("id", "incident_edges", r("mean_s_nontext", 8), r("mean_ratio", 8), r("mean_channels", 8), r("experimental_share", 8),
                      r("database_share", 8), "median_published", r("median_s_nontext", 8), "memberships")


@workload("channel_availability", f"""WITH {SQL_CHANNELS},
per AS (SELECT id, channel, avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS share FROM (
  SELECT u.id, channel, v FROM (UNPIVOT (SELECT src, dst, {", ".join(ev.NON_TEXT)} FROM idx) ON {", ".join(ev.NON_TEXT)} INTO NAME channel VALUE v) z,
  LATERAL (SELECT unnest([src, dst]) AS id) u) GROUP BY 1, 2),
nodes AS (SELECT 'P' || p_partkey AS id, p_brand AS stratum FROM part)
SELECT channel, stratum, count(*) AS nodes, round(avg(share), 8) AS mean_share FROM per JOIN nodes USING (id) GROUP BY 1, 2""")
def channel_availability(t):
    nodes = t.part.select(i.part_id("p_partkey").alias("id"), F.col("p_brand").alias("stratum"))
    return ev.channel_availability(index(t), nodes, stratum="stratum").withColumn("mean_share", F.round("mean_share", 8))


@workload("modifier_gate", """
WITH x AS (SELECT p_retailprice AS a, p_size AS b, p_partkey AS c FROM part),
k AS (SELECT a, b, c, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb,
 rank() OVER (ORDER BY c) AS rc FROM x)
SELECT 'a' AS modifier, NOT (corr(ra, rb) >= 0.5 OR corr(ra, rc) >= 0.5) AS usable, round(corr(ra, rb), 7) AS by_size, round(corr(ra, rc), 7) AS by_key FROM k""")
def modifier_gate(t):
    nodes = t.part.select(F.col("p_retailprice").alias("a"), F.col("p_size").alias("b"), F.col("p_partkey").alias("c"))
    out = ev.modifier_gate(cut(nodes), "a", ["b", "c"])
    return out.select("modifier", "usable", F.round(F.col("spearman")["b"], 7).alias("by_size"), F.round(F.col("spearman")["c"], 7).alias("by_key"))


@workload("support_flags", f"""WITH {SQL_CHANNELS}
SELECT 'P' || p_partkey AS id, x.combined_score, CASE WHEN x.src IS NULL THEN NULL ELSE experiments > 0 OR experiments_transferred > 0 END AS experimental_support,
 CASE WHEN x.src IS NULL THEN 'NO_DIRECT_INDEXED_TARGET_EDGE' ELSE 'INDEXED_TARGET_EDGE' END AS profile_status
FROM part LEFT JOIN (SELECT * FROM idx WHERE dst = 'S1') x ON x.src = 'P' || p_partkey""")
def support_flags(t):
    candidates = t.part.select(i.part_id("p_partkey").alias("id"))
    return ev.support_flags(candidates, index(t), "S1").select("id", "combined_score", "experimental_support", "profile_status")


@workload("bonus_bands", f"""WITH {SQL_CHANNELS}, {SQL_TEXT}, b AS (SELECT src, dst, round(s_nontext, 12) AS s, {sql_bonus('G1')} AS bonus FROM tx),
n AS (SELECT *, greatest(1, ceil((row_number() OVER (ORDER BY s, src, dst) - 1) * 3 / (count(*) OVER () - 1)::DOUBLE)) AS q FROM b)
SELECT CASE q WHEN 1 THEN 'LOW' WHEN 2 THEN 'MID' ELSE 'HIGH' END AS band, count(*) AS edges, round(avg(CASE WHEN bonus >= 1.001 THEN 1 ELSE 0 END), 7) AS meaningful_share,
 round(quantile_cont(bonus, 0.5), 8) AS median_bonus, round(quantile_cont(bonus, 0.95), 8) AS p95_bonus FROM n GROUP BY q""")
def bonus_bands(t):
    rows = ev.reweigh(ev.profiles_for(graph(t), index(t))).withColumn("s_nontext", F.round("s_nontext", 12))
    return au.band_audit(rows).select("band", "edges", r("meaningful_share", 7), r("median_bonus", 8), r("p95_bonus", 8))


def _grid_bonus(k, s):
    h = lambda x: f"(pow({x}, 2) / (pow({k}::DOUBLE, 2) + pow({x}, 2)))"
    return f"(1 + {s}::DOUBLE * {h('tx')} * {h('s')})"


@workload("bonus_grid", f"""WITH {SQL_CHANNELS}, {SQL_TEXT}, b AS (SELECT src, dst, round(s_nontext, 12) AS s, tx FROM tx),
n AS MATERIALIZED (SELECT *, greatest(1, ceil((row_number() OVER (ORDER BY s, src, dst) - 1) * 3 / (count(*) OVER () - 1)::DOUBLE)) AS q FROM b),
g AS ({" UNION ALL ".join(f"SELECT {k}::DOUBLE AS k, {s}::DOUBLE AS strength, q, {_grid_bonus(k, s)} AS bonus FROM n" for k in au.GRID_K for s in au.GRID_STRENGTH)})
SELECT k, strength, CASE q WHEN 1 THEN 'LOW' WHEN 2 THEN 'MID' ELSE 'HIGH' END AS band, round(quantile_cont(bonus, 0.5), 8) AS median_bonus,
 round(max(bonus), 8) AS max_bonus FROM g GROUP BY k, strength, q""")
def bonus_grid(t):
    text = ev.recombined(("textmining", "textmining_transferred"))
    rows = index(t).select("src", "dst", F.round("s_nontext", 12).alias("s_nontext"), text.alias("text"))
    return au.bonus_grid(rows).select("k", "strength", "band", r("median_bonus", 8), r("max_bonus", 8))


def two_responses(t):
    """Two rankings of the parts: by discounts and by taxes around their means."""
    rows = t.lineitem.groupBy("l_partkey").agg(F.round(F.sum("l_discount") - 1.5, 4).alias("a"), F.round(F.sum("l_tax") - 1.2, 4).alias("b"), F.count(F.lit(1)).alias("degree"), F.sum("l_quantity").alias("qty"))
    return cut(rows.withColumn("id", i.part_id()))


SQL_TWO = """two AS MATERIALIZED (SELECT 'P' || l_partkey AS id, round(sum(l_discount) - 1.5, 4) AS a, round(sum(l_tax) - 1.2, 4) AS b, count(*) AS degree, sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey)"""
SQL_RANKS = f"""{SQL_TWO}, rk AS (SELECT id, degree, qty, a, b, rank() OVER (ORDER BY abs(a) DESC) - rank() OVER (ORDER BY abs(b) DESC) AS promotion,
 rank() OVER (ORDER BY abs(a) DESC) AS ra, rank() OVER (ORDER BY abs(b) DESC) AS rb FROM two)"""


def pair_of(rows):
    return rows.select("id", F.col("a").alias("delta_pct")), rows.select("id", F.col("b").alias("delta_pct"))


@workload("paired_ranks", f"WITH {SQL_RANKS} SELECT id, ra AS reference_rank, rb AS candidate_rank, promotion, greatest(abs(a), abs(b)) >= 0.05 AS is_meaningful FROM rk")
def paired_ranks(t):
    return au.paired_ranks(*pair_of(two_responses(t))).select("id", "reference_rank", "candidate_rank", "promotion", "is_meaningful")


@workload("paired_ranks_positive", f"""WITH {SQL_TWO}, x AS (SELECT id, rank() OVER (ORDER BY CASE WHEN a > 0 THEN a END DESC NULLS LAST) AS ra,
 rank() OVER (ORDER BY CASE WHEN b > 0 THEN b END DESC NULLS LAST) AS rb, a, b FROM two)
SELECT id, ra - rb AS promotion FROM x WHERE a > 0 AND b > 0""")
def paired_ranks_positive(t):
    return au.paired_ranks(*pair_of(two_responses(t)), domain="positive").select("id", "promotion")


SQL_DECILE = "greatest(1, ceil((row_number() OVER (ORDER BY {c}, id) - 1) * 10 / (count(*) OVER () - 1)::DOUBLE))::INT"


@workload("promotion_audit", f"""WITH {SQL_RANKS}, n AS (SELECT *, {SQL_DECILE.format(c='degree')} AS d, row_number() OVER (ORDER BY degree DESC, id) AS rn, count(*) OVER () AS n FROM rk),
s AS (SELECT *, 'D' || d AS stratum FROM n UNION ALL SELECT *, CASE WHEN d <= 3 THEN 'Low_D1_D3' WHEN d <= 7 THEN 'Middle_D4_D7' ELSE 'High_D8_D9' END FROM n WHERE d < 10
 UNION ALL SELECT *, 'Top10pct' FROM n WHERE rn <= ceil(n * 0.1) UNION ALL SELECT *, 'Top5pct' FROM n WHERE rn <= ceil(n * 0.05) UNION ALL SELECT *, 'Top1pct' FROM n WHERE rn <= ceil(n * 0.01))
SELECT stratum, count(*) AS nodes, round(avg(promotion), 6) AS mean_promotion, quantile_cont(promotion, 0.5) AS median_promotion, round(avg(CASE WHEN promotion > 0 THEN 1 ELSE 0 END), 7) AS promoted_share,
 round(avg(CASE WHEN rb <= 50 AND ra > 50 THEN 1 ELSE 0 END), 7) AS entering_top50, round(avg(CASE WHEN ra <= 20 AND rb > 20 THEN 1 ELSE 0 END), 7) AS leaving_top20 FROM s GROUP BY stratum""")
def promotion_audit(t):
    rows = two_responses(t)
    ranks = cut(au.paired_ranks(*pair_of(rows)))
    strata = au.strata_of(au.with_deciles(rows.select("id", "degree"), ["degree"]), "degree")
    return au.promotion_summary(ranks, strata).select(
        "stratum", "nodes", r("mean_promotion", 6), "median_promotion", r("promoted_share", 7), r("entering_top50", 7), r("leaving_top20", 7))


@workload("matched_difference", f"""WITH {SQL_RANKS}, n AS (SELECT *, {SQL_DECILE.format(c='degree')} AS d, {SQL_DECILE.format(c='qty')} AS e FROM rk),
b AS (SELECT *, 'D' || d || '|D' || e AS match_bin, quantile_cont(qty, 0.5) OVER (PARTITION BY d, e) AS mid, count(*) OVER (PARTITION BY d, e) AS size_ FROM n)
SELECT match_bin, count(*) FILTER (WHERE qty > mid) AS high_n, count(*) FILTER (WHERE qty <= mid) AS low_n,
 quantile_cont(promotion, 0.5) FILTER (WHERE qty > mid) - quantile_cont(promotion, 0.5) FILTER (WHERE qty <= mid) AS difference
FROM b WHERE size_ >= 10 GROUP BY match_bin HAVING count(*) FILTER (WHERE qty > mid) > 0""")
def matched_difference(t):
    rows = two_responses(t)
    nodes = au.with_deciles(rows.select("id", "degree", "qty"), ["degree", "qty"])
    out = au.matched_difference(au.paired_ranks(*pair_of(rows)), nodes, coverage="qty", deciles=("degree_decile", "qty_decile"))
    return out.select("match_bin", "high_n", "low_n", "difference")


@workload("sign_vote", """
WITH x AS (SELECT l_shipdate < '1997-01-01' AS early, l_returnflag, l_linestatus, avg(l_discount - 0.05) AS m, avg(0.05 - l_discount) AS k FROM lineitem GROUP BY 1, 2, 3)
SELECT count(*) FILTER (WHERE m > 0) AS m_promoted, count(*) FILTER (WHERE k > 0) AS k_promoted, count(*) FILTER (WHERE m < 0) AS m_demoted, count(*) FILTER (WHERE k < 0) AS k_demoted,
 CASE WHEN count(*) FILTER (WHERE m > 0) >= 6 OR count(*) FILTER (WHERE k > 0) >= 6 THEN 'BIAS_WARNING' ELSE 'PARTIAL' END AS judgment FROM x""")
def sign_vote(t):
    rows = t.lineitem.groupBy((F.col("l_shipdate") < "1997-01-01").alias("early"), "l_returnflag", "l_linestatus").agg(
        F.avg(F.col("l_discount") - 0.05).alias("m"), F.avg(0.05 - F.col("l_discount")).alias("k"))
    return au.sign_vote(rows, ["m", "k"])


@workload("graph_parity", f"""WITH {i.SQL_PAIRS}, a AS (SELECT src, dst, score::DOUBLE AS w FROM pairs WHERE score >= 300), b AS (SELECT src, dst, score * 1.01::DOUBLE AS w FROM pairs WHERE score >= 350 OR score % 20 = 0),
j AS (SELECT a.w AS x, b.w AS y FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst),
na AS (SELECT src AS id FROM a UNION SELECT dst FROM a), nb AS (SELECT src AS id FROM b UNION SELECT dst FROM b)
SELECT count(*) FILTER (WHERE y IS NULL) AS only_left, count(*) FILTER (WHERE x IS NULL) AS only_right, round(max(abs(x - y)), 6) AS max_abs_difference, round(max(abs(x - y) / x), 8) AS max_rel_difference,
 (SELECT count(*) FROM na FULL JOIN nb ON na.id = nb.id WHERE na.id IS NULL OR nb.id IS NULL) AS nodes_on_one_side FROM j""")
def graph_parity(t):
    rows = i.interactions(t)
    left = rows.where("score >= 300").select("src", "dst", F.col("score").cast("double").alias("weight"))
    right = rows.where("score >= 350 OR score % 20 = 0").select("dst", "src", (F.col("score") * 1.01).alias("weight"))
    out = au.graph_parity(left, right.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return out.withColumns({"max_abs_difference": F.round("max_abs_difference", 6), "max_rel_difference": F.round("max_rel_difference", 8)})


@workload("benchmark_agreement", f"""WITH {SQL_TWO}, k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS xa, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS xb,
 row_number() OVER (ORDER BY abs(a) DESC, id) AS na, row_number() OVER (ORDER BY abs(b) DESC, id) AS nb,
 row_number() OVER (ORDER BY CASE WHEN a > 0 THEN a END DESC NULLS LAST, id) AS pa, row_number() OVER (ORDER BY CASE WHEN b > 0 THEN b END DESC NULLS LAST, id) AS pb FROM two)
SELECT count(*) AS n, round(corr(xa, xb), 7) AS spearman, round(corr(a, b), 7) AS pearson, count(*) FILTER (WHERE greatest(abs(a), abs(b)) >= 0.05 AND sign(a) <> sign(b)) AS sign_flips,
 count(*) FILTER (WHERE na <= 100 AND nb <= 100) AS absolute_top100_overlap, count(*) FILTER (WHERE pa <= 50 AND pb <= 50) AS positive_top50_overlap FROM k""")
def benchmark_agreement(t):
    out = au.benchmark(*pair_of(two_responses(t)))
    return out.select("n", r("spearman", 7), r("pearson", 7), "sign_flips", "absolute_top100_overlap", "positive_top50_overlap")


@workload("snapshot_difference", """
WITH a AS (SELECT 'part.' || p_partkey AS path, p_retailprice AS x, p_brand AS s FROM part),
b AS (SELECT 'part.' || p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice * 1.001 ELSE p_retailprice END AS x, CASE WHEN p_partkey % 11 = 0 THEN 'other' ELSE p_brand END AS s FROM part WHERE p_partkey % 5 <> 0)
SELECT path, CASE WHEN b.path IS NULL THEN 'missing' WHEN abs(a.x - b.x) > 1e-6 THEN 'number' ELSE 'text' END AS difference FROM a LEFT JOIN b USING (path)
WHERE b.path IS NULL OR abs(a.x - b.x) > 1e-6 OR a.s <> b.s""")
def snapshot_difference(t):
    path = F.concat(F.lit("part."), F.col("p_partkey").cast("string"))
    a = t.part.select(path.alias("path"), F.col("p_retailprice").alias("number"), F.col("p_brand").alias("text"))
    b = t.part.where("p_partkey % 5 <> 0").select(
        path.alias("path"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_retailprice") * 1.001).otherwise(F.col("p_retailprice")).alias("number"),
        F.when(F.col("p_partkey") % 11 == 0, "other").otherwise(F.col("p_brand")).alias("text"))
    return au.snapshot_difference(a, b)


@workload("table_parity", f"""WITH {i.SQL_LEVELS}, a AS (SELECT id, context, max(level) AS level FROM levels GROUP BY 1, 2), b AS (SELECT id, context, max(level) AS level FROM levels WHERE level < 50 GROUP BY 1, 2)
SELECT count(*) AS rows, count(b.id) AS matched, count(*) FILTER (WHERE a.level = b.level) AS exact, max(abs(a.level - b.level)) AS max_difference FROM a LEFT JOIN b ON a.id = b.id AND a.context = b.context""")
def table_parity(t):
    rows = i.levels(t)
    peak = lambda df: df.groupBy("id", "context").agg(F.max("level").alias("level"))
    return au.table_parity(peak(rows), peak(rows.where("level < 50")), ["id", "context"], "level")
