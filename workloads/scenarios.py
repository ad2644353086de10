"""Scores and what-if scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshflux.operators import edges as e
from meshflux.operators import scores as sc
from meshflux.operators.propagation import Scenario, pagerank, symmetric_arcs
from meshflux.plans import scenarios as p
from meshflux.session import cut
from meshflux.settings import PRESET_ITERATIONS
from workloads import inputs as i
from workloads.registry import workload

CONTEXT = "NATION_7"


def r(name, digits):
    return F.round(name, digits).alias(name)


@workload("pagerank", f"WITH RECURSIVE {i.sql_edges()},{i.sql_pagerank('pr', 'arcs')} SELECT id, round(pagerank, 9) AS pagerank FROM pr")
def undirected_pagerank(t):
    return pagerank(symmetric_arcs(i.plain_graph(t))).select("id", r("pagerank", 9))


@workload("restart_walk", f"""WITH RECURSIVE {i.sql_edges()},
st AS MATERIALIZED (SELECT src AS id, sum(weight) AS s FROM arcs GROUP BY src),
q AS MATERIALIZED (SELECT a.src, a.dst, a.weight / s.s AS q FROM arcs a JOIN st s ON a.src = s.id),
v AS MATERIALIZED (SELECT id, CASE WHEN id IN ('P1', 'P2', 'S3') THEN 1.0::DOUBLE / 3 ELSE 0.0::DOUBLE END AS v FROM st),
it AS (SELECT id, v AS x, 0 AS k FROM v UNION ALL
  SELECT q.dst, 0.5::DOUBLE * max(v.v) + 0.5::DOUBLE * sum(q.q * it.x), max(it.k) + 1
  FROM it JOIN q ON it.id = q.src JOIN v ON v.id = q.dst WHERE it.k < 60 GROUP BY q.dst)
SELECT id, round(x, 9) AS pagerank FROM it WHERE k = 60""")
def restart_walk(t):
    seeds = t.spark.createDataFrame([("P1", 1.0), ("P2", 1.0), ("S3", 1.0)], "id string, mass double")
    out = pagerank(symmetric_arcs(i.plain_graph(t)), restart=seeds, damping=0.5)
    return out.select("id", r("pagerank", 9))


IMPORTANCE_SQL = f"""WITH RECURSIVE {i.sql_edges()},{i.sql_pagerank('pr', 'arcs')},
deg AS (SELECT src AS id, count(*) AS degree, max(score) AS max_score FROM (
   SELECT src, dst, score FROM edges UNION ALL SELECT dst, src, score FROM edges) GROUP BY src),
n AS (SELECT id, round(pagerank, 11) AS pagerank, degree, max_score FROM pr JOIN deg USING (id)),
rk AS (SELECT *, rank() OVER (ORDER BY pagerank) + (count(*) OVER (PARTITION BY pagerank) - 1) / 2.0 AS a,
   rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2.0 AS b, count(*) OVER () AS n FROM n),
sc AS (SELECT id, degree, max_score, a / n AS share, (0.6 * a / n + 0.4 * b / n) * 100 AS importance FROM rk)"""


def scored(t):
    graph = cut(i.plain_graph(t))
    ranks = pagerank(symmetric_arcs(graph)).select("id", F.round("pagerank", 11).alias("pagerank"))
    return sc.importance(cut(ranks.join(e.degree_summary(graph), "id")))


@workload("importance", f"{IMPORTANCE_SQL} SELECT id, degree, round(importance, 6) AS importance FROM sc")
def importance(t):
    return scored(t).select("id", "degree", r("importance", 6))


@workload("tiers", f"""{IMPORTANCE_SQL}, c AS (SELECT quantile_cont(share, 0.05) AS cut FROM sc)
SELECT tier, count(*) AS nodes FROM (SELECT CASE WHEN degree <= 4 AND max_score < 700 AND share <= cut THEN 'noise'
  WHEN importance >= 99 THEN 'top' WHEN importance >= 90 THEN 'strategic' WHEN importance >= 50 THEN 'bridge' ELSE 'peripheral' END AS tier FROM sc, c) GROUP BY tier""")
def tiers(t):
    return sc.tiers(cut(scored(t))).groupBy("tier").agg(F.count(F.lit(1)).alias("nodes"))


def what_if_sql(targets: str, factor: float, graph: str) -> str:
    return f"""WITH RECURSIVE {graph},
arcs2 AS MATERIALIZED (SELECT src, dst, CASE WHEN src IN ({targets}) OR dst IN ({targets}) THEN weight * {factor!r}::DOUBLE ELSE weight END AS weight FROM arcs),
{i.sql_pagerank('pa', 'arcs')},{i.sql_pagerank('pb', 'arcs2')},
resp AS MATERIALIZED (SELECT id, pa.pagerank AS baseline, pb.pagerank AS perturbed, pb.pagerank - pa.pagerank AS delta,
  (pb.pagerank - pa.pagerank) / pa.pagerank * 100 AS delta_pct FROM pa JOIN pb USING (id))"""


def context_arcs(t, context=CONTEXT):
    return cut(symmetric_arcs(e.context_graph(i.interactions(t), i.levels(t), context=context, threshold=300)))


@workload("what_if_gains", f"""{what_if_sql("'S1'", 0.001, i.sql_context_edges(CONTEXT))}
SELECT id, round(delta_pct, 5) AS delta_pct FROM resp WHERE id <> 'S1' AND delta_pct > 0.05 ORDER BY round(delta_pct, 5) DESC, id LIMIT 25""")
def what_if_gains(t):
    arcs = context_arcs(t)
    table = p.scenario_table(t.spark, {"hit": ["S1"]})
    responses = p.without_targets(p.what_if(arcs, table), table).withColumn("delta_pct", F.round("delta_pct", 5))
    return p.positive_gains(responses, top_n=25).select("id", "delta_pct")


@workload("what_if_responses", f"""{what_if_sql("'S1', 'P3'", 0.05, i.sql_edges())}
SELECT id, round(baseline, 9) AS baseline, round(delta, 9) AS delta, round(delta_pct, 4) AS delta_pct,
  CASE WHEN delta > 0 THEN 'gain' WHEN delta < 0 THEN 'loss' ELSE 'no change' END AS direction FROM resp""")
def what_if_responses(t):
    arcs = cut(symmetric_arcs(i.plain_graph(t)))
    table = p.scenario_table(t.spark, {"hit": ["S1", "P3"]}, 0.05)
    return p.what_if(arcs, table).select("id", r("baseline", 9), r("delta", 9), r("delta_pct", 4), "direction")


@workload("system_shift", f"""{what_if_sql("'S1'", 0.001, i.sql_edges())}
SELECT 'hit' AS scenario_id, round(sum(abs(delta)) / 2, 8) AS total_variation, round(100.0 * avg(CASE WHEN abs(delta) > 1e-6 THEN 1 ELSE 0 END), 4) AS moved_pct,
  round(100 * sum(abs(delta)) / 4 + 50.0 * avg(CASE WHEN abs(delta) > 1e-6 THEN 1 ELSE 0 END), 4) AS system_shift_pct FROM resp""")
def system_shift(t):
    arcs = cut(symmetric_arcs(i.plain_graph(t)))
    responses = p.what_if(arcs, p.scenario_table(t.spark, {"hit": ["S1"]}))
    return p.system_shift(responses).select("scenario_id", r("total_variation", 8), r("moved_pct", 4), r("system_shift_pct", 4))


REPORT_SOURCES = ("S1", "P3", "S5")


def distances_sql(name: str, arcs: str) -> str:
    """CTEs ending in ``name(source, id, dist)``: shortest distances from the report's sources; arcs have a distance."""
    values = ", ".join(f"('{s}')" for s in REPORT_SOURCES)
    return f"""
{name}_r AS (SELECT s AS source, s AS id, 0.0::DOUBLE AS dist, 0 AS k FROM (VALUES {values}) v(s)
  UNION ALL SELECT source, id, min(dist), k + 1 FROM (
    SELECT source, id, dist, k FROM {name}_r UNION ALL SELECT r.source, a.dst, r.dist + a.distance, r.k FROM {name}_r r JOIN {arcs} a ON r.id = a.src) u
  WHERE k < 30 GROUP BY source, id, k),
{name} AS MATERIALIZED (SELECT source, id, dist FROM {name}_r WHERE k = 30)"""


@workload("what_if_report", f"""{what_if_sql("'S1', 'P3'", 0.05, i.sql_edges())},
da AS MATERIALIZED (SELECT src, dst, 1 / weight AS distance FROM arcs), db AS MATERIALIZED (SELECT src, dst, 1 / weight AS distance FROM arcs2),
{distances_sql("ga", "da")},{distances_sql("gb", "db")},
n AS (SELECT count(DISTINCT src) AS n FROM arcs),
ef AS (SELECT (SELECT sum(1 / dist) FROM ga WHERE dist > 0) / ({len(REPORT_SOURCES)} * (n - 1)) AS a, (SELECT sum(1 / dist) FROM gb WHERE dist > 0) / ({len(REPORT_SOURCES)} * (n - 1)) AS b FROM n),
sh AS (SELECT sum(abs(delta)) / 2 AS tvd, 100.0 * avg(CASE WHEN abs(delta) > 1e-6 THEN 1 ELSE 0 END) AS moved FROM resp)
SELECT 'hit' AS scenario_id, round(tvd, 8) AS total_variation, round(moved, 4) AS moved_pct, round(50 * tvd + moved / 2, 4) AS system_shift_pct,
 round(a, 9) AS efficiency_before, round(b, 9) AS efficiency_after, round((b - a) / a * 100, 5) AS efficiency_change_pct FROM sh, ef""")
def what_if_report(t):
    """System shift by residuals, and efficiency from three sources before and after."""
    arcs = cut(symmetric_arcs(i.plain_graph(t)))
    table = p.scenario_table(t.spark, {"hit": ["S1", "P3"]}, 0.05)
    sources = t.spark.createDataFrame([(s,) for s in REPORT_SOURCES], "id string")
    report = p.what_if_report(arcs, table, sources=sources)
    return report.select("scenario_id", r("total_variation", 8), r("moved_pct", 4), r("system_shift_pct", 4), r("efficiency_before", 9), r("efficiency_after", 9), r("efficiency_change_pct", 5))


@workload("selection_policies", f"""{what_if_sql("'S1'", 0.001, i.sql_edges())},
x AS (SELECT id, round(abs(delta), 13) AS a FROM resp WHERE id <> 'S1'),
s AS (SELECT count(*) AS strong FROM x WHERE a >= (SELECT quantile_cont(a, 0.99) FROM x) AND a > 0)
SELECT 'percentile' AS mode, strong AS rows FROM s UNION ALL SELECT 'top_n', 40 UNION ALL SELECT 'null_fdr', 30
UNION ALL SELECT 'top_positive', CAST(round((SELECT avg(d) FROM (SELECT delta_pct AS d FROM resp WHERE id <> 'S1' AND delta > 0 ORDER BY d DESC LIMIT 100)) * 1000) AS BIGINT)""")
def selection_policies(t):
    arcs = cut(symmetric_arcs(i.plain_graph(t)))
    table = p.scenario_table(t.spark, {"hit": ["S1"]})
    responses = cut(p.without_targets(p.what_if(arcs, table), table).withColumn("abs_delta", F.round("abs_delta", 13)))
    out = None
    for mode, n in (("percentile", 0), ("top_n", 40), ("null_fdr", 30)):
        rows = p.classify(responses, mode=mode, top_n=n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(mode).alias("mode"), "rows")
        out = rows if out is None else out.unionByName(rows)
    mean = p.top_positive_mean(responses).select(F.lit("top_positive").alias("mode"), F.round(F.col("top_positive_mean_pct") * 1000).cast("bigint").alias("rows"))
    return out.unionByName(mean)


FRACTIONS = {"Mild": 0.5, "Moderate": 0.2, "Strong": 0.05, "Near-complete": 0.001}


@workload("severity_sweep", f"""WITH RECURSIVE {i.sql_edges()}, sc AS (SELECT * FROM (VALUES {", ".join(f"('{n}', ['S1', 'S2'], {f!r}::DOUBLE)" for n, f in FRACTIONS.items())}) v(sid, ids, factor)),
{i.sql_responses()}, rs AS MATERIALIZED (SELECT * FROM resp WHERE id NOT IN ('S1', 'S2')), {i.sql_shift("rs")}, {i.sql_efficiencies(REPORT_SOURCES)},
li AS (SELECT scenario_id, quantile_cont(abs(delta), {p.SELECTION_PERCENTILE / 100.0!r}) AS l FROM rs GROUP BY 1),
bu AS (SELECT scenario_id, sum(abs(delta)) AS burden, count(*) FILTER (WHERE abs(delta) >= l AND delta <> 0) AS strong_responses FROM rs JOIN li USING (scenario_id) GROUP BY 1)
SELECT scenario_id, round(burden, 8) AS burden, strong_responses, round(system_shift_pct, 4) AS system_shift_pct, round((b.e - a.e) / a.e * 100, 5) AS efficiency_change_pct
FROM bu JOIN shift USING (scenario_id) JOIN ef b ON b.context = scenario_id JOIN ef a ON a.context = 'base'""")
def severity_sweep(t):
    arcs = cut(symmetric_arcs(i.plain_graph(t)))
    sources = t.spark.createDataFrame([(s,) for s in REPORT_SOURCES], "id string")
    out = p.severity_sweep(arcs, ["S1", "S2"], FRACTIONS, sources=sources)
    return out.select("scenario_id", r("burden", 8), "strong_responses", r("system_shift_pct", 4), r("efficiency_change_pct", 5))


@workload("batch_sweep", f"""WITH RECURSIVE {i.sql_edges()}, sc AS MATERIALIZED (SELECT src AS sid, [src] AS ids, {p.BLOCK_FRACTION!r}::DOUBLE AS factor FROM arcs GROUP BY src ORDER BY count(*) DESC, src LIMIT 12),
{i.sql_responses()}, {i.sql_shift("resp")},
ex AS (SELECT scenario_id, max(delta_pct) AS gain_pct, arg_max(id, delta_pct) AS gain_id, min(delta_pct) AS loss_pct, arg_min(id, delta_pct) AS loss_id FROM resp WHERE id <> scenario_id GROUP BY 1)
SELECT scenario_id, round(total_variation, 8) AS total_variation, round(moved_pct, 4) AS moved_pct, round(system_shift_pct, 4) AS system_shift_pct, gain_id, round(gain_pct, 4) AS gain_pct, loss_id, round(loss_pct, 4) AS loss_pct FROM shift JOIN ex USING (scenario_id)""")
def batch_sweep(t):
    """One scenario for each of the best-connected nodes, in one batched run."""
    graph = cut(i.plain_graph(t))
    scores = e.degree_summary(graph).select("id", F.col("degree").alias("importance"))
    out = p.batch_sweep(cut(symmetric_arcs(graph)), scores, top_n=12)
    return out.select("scenario_id", r("total_variation", 8), r("moved_pct", 4), r("system_shift_pct", 4), "gain_id", r("gain_pct", 4), "loss_id", r("loss_pct", 4))


@workload("null_p_values", None)
def null_p_values(t):
    """Degree-matched empirical p-values and their adjusted values."""
    arcs = cut(symmetric_arcs(i.plain_graph(t)))
    table = p.scenario_table(t.spark, {"hit": ["S1", "P3"]}, 0.05)
    responses = cut(p.without_targets(p.what_if(arcs, table), table))
    ps = p.null_p_values(arcs, responses, ["S1", "P3"], factor=0.05, iterations=PRESET_ITERATIONS["standard"])
    return p.classify(responses, p_values=ps, top_n=50)


def dose_sql(dose, target="P1"):
    lost = 1 - dose
    keep = 1 - lost ** 2 / (0.25 + lost ** 2)
    lift = 0.1 * lost ** 2 / (0.25 + lost ** 2)
    tag = f"d{int(round(dose * 100))}"
    return tag, f"""{tag}_a AS MATERIALIZED (SELECT src, dst, CASE WHEN src = '{target}' OR dst = '{target}' THEN weight * {keep!r}::DOUBLE
   WHEN {lift!r} > 0.001 AND (src IN (SELECT id FROM strong) OR dst IN (SELECT id FROM strong)) THEN weight * (1 + {lift!r}::DOUBLE) ELSE weight END AS weight FROM arcs),
{tag}_q AS MATERIALIZED (SELECT a.src, a.dst, a.weight / s.s AS q FROM {tag}_a a JOIN (SELECT src, sum(weight) AS s FROM {tag}_a GROUP BY src) s USING (src)),
{tag}_i AS (SELECT id, v AS x, 0 AS k FROM v UNION ALL
  SELECT q.dst, 0.5::DOUBLE * max(v.v) + 0.5::DOUBLE * sum(q.q * i.x), max(i.k) + 1 FROM {tag}_i i JOIN {tag}_q q ON i.id = q.src JOIN v ON v.id = q.dst WHERE i.k < 55 GROUP BY q.dst),
{tag} AS (SELECT x FROM {tag}_i WHERE k = 55 AND id = '{target}')"""


DOSES = (0.9, 0.5, 0.1)


@workload("dose_response", f"""WITH RECURSIVE {i.sql_edges()},
v AS MATERIALIZED (SELECT DISTINCT src AS id, CASE WHEN src = 'P1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM arcs),
strong AS (SELECT dst AS id FROM arcs WHERE src = 'P1' AND 1000 * sqrt(weight) >= 200),
{dose_sql(1.0)[1]}, {", ".join(dose_sql(d)[1] for d in DOSES)}
{" UNION ALL ".join(f"SELECT {d!r}::DOUBLE AS survival, round((d100.x - {dose_sql(d)[0]}.x) / d100.x * 100, 5) AS loss_pct FROM d100, {dose_sql(d)[0]}" for d in DOSES)}""")
def dose_response(t):
    out = p.dose_response(i.plain_graph(t), ["P1"], doses=DOSES)
    return out.select("survival", r("loss_pct", 5))


STRESSED, STRESS_DOSES = "S2", (0.5, 0.25)
#: From ``edges``, ``arcs``: betweenness ``bc(c, id, b)`` at survival c from the report's sources, and the five first gains of a dose, ``rk``.
#: Lengths are whole numbers, so equal paths tie exactly.
SQL_STRESS = f"""ka AS MATERIALIZED (SELECT c, src, dst, (1001 - score)::DOUBLE / CASE WHEN src = '{STRESSED}' OR dst = '{STRESSED}' THEN c ELSE 1 END AS distance
  FROM (SELECT src, dst, score FROM edges UNION ALL SELECT dst, src, score FROM edges), (VALUES (1.0::DOUBLE), {", ".join(f"({d!r}::DOUBLE)" for d in STRESS_DOSES)}) v(c)),
rx AS (SELECT c, s AS source, s AS id, 0.0::DOUBLE AS dist, 0 AS k FROM (VALUES {", ".join(f"('{s}')" for s in REPORT_SOURCES)}) v(s), (SELECT DISTINCT c FROM ka) WHERE s IN (SELECT src FROM arcs)
  UNION ALL SELECT c, source, id, min(dist), k + 1 FROM (SELECT c, source, id, dist, k FROM rx UNION ALL
    SELECT r.c, r.source, a.dst, r.dist + a.distance, r.k FROM rx r JOIN ka a ON r.id = a.src AND r.c = a.c) u WHERE k < 30 GROUP BY c, source, id, k),
best AS MATERIALIZED (SELECT c, source, id, dist FROM rx WHERE k = 30),
dag AS MATERIALIZED (SELECT x.c, x.source, a.src, a.dst FROM best x JOIN ka a ON a.c = x.c AND a.src = x.id JOIN best y ON y.c = x.c AND y.source = x.source AND y.id = a.dst WHERE x.dist + a.distance = y.dist),
up AS (SELECT DISTINCT c, source, source AS id, 1.0::DOUBLE AS v, 0 AS k FROM best
  UNION ALL SELECT u.c, u.source, d.dst, sum(u.v), max(u.k) + 1 FROM up u JOIN dag d ON d.c = u.c AND d.source = u.source AND d.src = u.id WHERE u.k < 30 GROUP BY 1, 2, 3),
sg AS MATERIALIZED (SELECT c, source, id, sum(v) AS s FROM up GROUP BY 1, 2, 3),
sh AS MATERIALIZED (SELECT d.c, d.source, d.src, d.dst, x.s / y.s AS f FROM dag d JOIN sg x ON x.c = d.c AND x.source = d.source AND x.id = d.src JOIN sg y ON y.c = d.c AND y.source = d.source AND y.id = d.dst),
dn AS (SELECT c, source, src AS id, sum(f) AS v, 1 AS k FROM sh GROUP BY 1, 2, 3
  UNION ALL SELECT n.c, n.source, s.src, sum(n.v * s.f), max(n.k) + 1 FROM dn n JOIN sh s ON s.c = n.c AND s.source = n.source AND s.dst = n.id WHERE n.k < 30 GROUP BY 1, 2, 3),
bc AS MATERIALIZED (SELECT n.c, n.id, coalesce(sum(v), 0) / 2 * (SELECT count(DISTINCT src) FROM arcs) / (SELECT count(DISTINCT source) FROM best) AS b
  FROM (SELECT DISTINCT c, src AS id FROM ka) n LEFT JOIN dn ON dn.c = n.c AND dn.id = n.id AND dn.source <> dn.id GROUP BY n.c, n.id),
nr AS (SELECT '{STRESSED}' AS id, 0 AS k UNION SELECT a.dst, nr.k + 1 FROM nr JOIN arcs a ON nr.id = a.src WHERE nr.k < 3),
rk AS MATERIALIZED (SELECT * FROM (SELECT y.c AS survival, row_number() OVER (PARTITION BY y.c ORDER BY round(y.b - x.b, 6) DESC, id) AS rank, id, x.b AS before, y.b AS after, round(y.b - x.b, 6) AS delta
  FROM bc x JOIN bc y USING (id) WHERE x.c = 1 AND y.c < 1 AND round(y.b - x.b, 6) > 0 AND id IN (SELECT id FROM nr)) WHERE rank <= 5)"""


def stress_arguments(t):
    graph = cut(i.plain_graph(t).withColumn("distance", (F.lit(1001) - F.col("score")).cast("double")))
    seeds, sources = (t.spark.createDataFrame([(x,) for x in ids], "id string") for ids in ((STRESSED,), REPORT_SOURCES))
    return graph, dict(seeds=seeds, hops=3, sources=sources, doses=STRESS_DOSES)


@workload("dose_stress", f"""WITH RECURSIVE {i.sql_edges()}, {SQL_STRESS}
SELECT survival, rank, id, round(before, 4) AS before, round(after, 4) AS after, round(delta, 4) AS delta FROM rk""")
def dose_stress(t):
    graph, arguments = stress_arguments(t)
    return p.dose_stress(graph, [STRESSED], **arguments).select("survival", "rank", "id", r("before", 4), r("after", 4), r("delta", 4))


@workload("dose_report", f"""WITH RECURSIVE {i.sql_edges()}, {SQL_STRESS},
v AS MATERIALIZED (SELECT DISTINCT src AS id, CASE WHEN src = '{STRESSED}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM arcs),
strong AS (SELECT dst AS id FROM arcs WHERE src = '{STRESSED}' AND 1000 * sqrt(weight) >= 200),
{dose_sql(1.0, STRESSED)[1]}, {", ".join(dose_sql(d, STRESSED)[1] for d in STRESS_DOSES)},
cn AS (SELECT count(*) FILTER (WHERE src = '{STRESSED}' OR dst = '{STRESSED}') AS hit, count(*) FILTER (WHERE src <> '{STRESSED}' AND dst <> '{STRESSED}' AND (src IN (SELECT id FROM strong) OR dst IN (SELECT id FROM strong))) AS lifted FROM edges),
ls AS (SELECT survival, string_agg(id, ' ' ORDER BY rank) AS stressed, max(delta) AS most FROM rk GROUP BY 1),
ds AS ({" UNION ALL ".join(f"SELECT {d!r}::DOUBLE AS survival, d100.x AS base, {dose_sql(d, STRESSED)[0]}.x AS x FROM d100, {dose_sql(d, STRESSED)[0]}" for d in STRESS_DOSES)})
SELECT survival, round((1 - survival) * 100, 1) AS inhibition_pct, round(0.1 * pow(1 - survival, 2) / (0.25 + pow(1 - survival, 2)), 9) AS boost, hit AS suppressed_edges, lifted AS boosted_edges,
  round(base, 8) AS baseline_signal, round(x, 8) AS signal, round((base - x) / base * 100, 5) AS loss_pct, coalesce(stressed, '') AS stressed, round(coalesce(most, 0), 4) AS max_congestion
FROM ds LEFT JOIN ls USING (survival), cn""")
def dose_report(t):
    """Signal lost, edges changed and congested nodes of every dose."""
    graph, arguments = stress_arguments(t)
    out = p.dose_report(graph, [STRESSED], **arguments)
    return out.select(
        "survival", "inhibition_pct", r("boost", 9), "suppressed_edges", "boosted_edges", r("baseline_signal", 8), r("signal", 8), r("loss_pct", 5),
        F.array_join("stressed", " ").alias("stressed"), r("max_congestion", 4))


@workload("half_loss_dose", """
WITH d AS (SELECT 1 - l_discount * 9 AS survival, 100.0 * l_discount * 9 * l_discount * 9 AS loss FROM (SELECT DISTINCT l_discount FROM lineitem)),
w AS (SELECT survival, loss, lead(survival) OVER (ORDER BY survival DESC) AS ns, lead(loss) OVER (ORDER BY survival DESC) AS nl, row_number() OVER (ORDER BY survival DESC) AS p FROM d)
SELECT round(survival + (50 - loss) / (nl - loss + 1e-12) * (ns - survival), 6) AS half_loss_survival, 'interpolated' AS status
FROM w WHERE loss <= 50 AND nl >= 50 ORDER BY p LIMIT 1""")
def half_loss_dose(t):
    lost = F.col("l_discount") * 9
    doses = t.lineitem.select("l_discount").distinct().select((1 - lost).alias("survival"), (lost * lost * 100.0).alias("loss_pct"))
    return p.half_loss_dose(doses).select(r("half_loss_survival", 6), "status")


@workload("context_overlap", f"""WITH {i.SQL_LEVELS}, m AS MATERIALIZED (SELECT DISTINCT context, id FROM levels),
z AS (SELECT context, count(*) AS n FROM m GROUP BY 1), s AS (SELECT a.context AS x, b.context AS y, count(*) AS shared FROM m a JOIN m b ON a.id = b.id AND a.context < b.context GROUP BY 1, 2)
SELECT p.context AS context_a, q.context AS context_b, p.n AS members_a, q.n AS members_b, coalesce(shared, 0) AS shared, p.n + q.n - coalesce(shared, 0) AS "union",
  round(coalesce(shared, 0) / (p.n + q.n - coalesce(shared, 0))::DOUBLE, 9) AS jaccard FROM z p JOIN z q ON p.context < q.context LEFT JOIN s ON x = p.context AND y = q.context""")
def context_overlap(t):
    return p.context_overlap(i.levels(t)).withColumn("jaccard", F.round("jaccard", 9))


@workload("context_differential", f"""WITH RECURSIVE {i.SQL_PAIRS}, {i.SQL_LEVELS},
tally AS (SELECT ln(1 + level) AS v, count(*) AS n FROM levels WHERE level > 0 GROUP BY 1),
cum AS (SELECT v, sum(n) OVER (ORDER BY v) AS c, sum(n) OVER () AS total FROM tally),
lim AS (SELECT min(v) FILTER (WHERE c >= 0.01 * total) AS q01, min(v) FILTER (WHERE c >= 0.99 * total) AS q99 FROM cum),
mem AS (SELECT context, id, max(level) AS level FROM levels WHERE level > 0 GROUP BY 1, 2),
ce AS MATERIALIZED (SELECT a.context, src, dst, pow(score / 1000.0::DOUBLE, 2) * (0.1::DOUBLE + 0.9::DOUBLE * sqrt(greatest(0, least(1, (ln(1 + a.level) - q01) / (q99 - q01))) * greatest(0, least(1, (ln(1 + b.level) - q01) / (q99 - q01))))) AS weight
  FROM pairs JOIN mem a ON src = a.id JOIN mem b ON dst = b.id AND a.context = b.context, lim WHERE score >= 300),
hit AS MATERIALIZED (SELECT context, list_distinct(list(x)) AS ids FROM (SELECT context, unnest([src, dst]) AS x FROM ce) WHERE x IN ('S1', 'P3') GROUP BY 1),
ar AS MATERIALIZED (SELECT context, src, dst, weight FROM ce JOIN hit USING (context) UNION ALL SELECT context, dst, src, weight FROM ce JOIN hit USING (context)),
ar2 AS MATERIALIZED (SELECT context, src, dst, CASE WHEN src IN ('S1', 'P3') OR dst IN ('S1', 'P3') THEN weight * {p.BLOCK_FRACTION!r}::DOUBLE ELSE weight END AS weight FROM ar),
{i.sql_keyed_walk('ka', 'ar')},{i.sql_keyed_walk('kb', 'ar2')},
df AS MATERIALIZED (SELECT context, id, kb.pagerank - ka.pagerank AS delta, (kb.pagerank - ka.pagerank) / ka.pagerank * 100 AS delta_pct FROM ka JOIN kb USING (context, id) WHERE id NOT IN ('S1', 'P3')),
li AS (SELECT context, quantile_cont(abs(delta), {p.SELECTION_PERCENTILE / 100.0!r}) AS l FROM df GROUP BY 1),
cr AS MATERIALIZED (SELECT df.* FROM df JOIN li USING (context) WHERE abs(delta) >= l AND delta <> 0)
SELECT context, id, round(delta_pct, 4) AS delta_pct, CASE WHEN delta > 0 THEN 'gain' ELSE 'loss' END AS direction, count(*) OVER (PARTITION BY id) AS contexts,
  CASE WHEN count(*) OVER (PARTITION BY id) = (SELECT count(*) FROM hit) THEN 'conserved' ELSE 'context_specific' END AS response_type FROM cr""")
def context_differential(t):
    """One scenario in the graphs of all nations, solved together."""
    graphs = cut(e.context_graphs(i.interactions(t), i.levels(t), threshold=300))
    arcs = graphs.select("context", "src", "dst", "weight").unionByName(graphs.select("context", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return p.context_differential(arcs, ["S1", "P3"]).select("context", "id", r("delta_pct", 4), "direction", "contexts", "response_type")


@workload("interaction", f"""WITH RECURSIVE {i.sql_edges()}, sc AS (SELECT * FROM (VALUES ('single_S1', ['S1'], {p.BLOCK_FRACTION!r}::DOUBLE), ('single_S2', ['S2'], {p.BLOCK_FRACTION!r}::DOUBLE), ('combined', ['S1', 'S2'], {p.BLOCK_FRACTION!r}::DOUBLE)) v(sid, ids, factor)),
{i.sql_responses()}, {i.sql_shift("resp")}, {i.sql_efficiencies(REPORT_SOURCES)},
x AS (SELECT scenario_id, 'system_shift_pct' AS metric, 4 AS digits, system_shift_pct AS effect FROM shift UNION ALL
  SELECT b.context, 'global_efficiency_change', 9, b.e - a.e FROM ef b JOIN ef a ON a.context = 'base' AND b.context <> 'base'),
y AS (SELECT metric, digits, sum(effect) FILTER (WHERE scenario_id <> 'combined') AS w, max(effect) FILTER (WHERE scenario_id = 'combined') AS o FROM x GROUP BY 1, 2)
SELECT metric, round(w, digits) AS expected, round(o, digits) AS observed, round(o - w, digits) AS residual, CASE WHEN (abs(o) - abs(w)) / greatest(abs(w), 1e-12) > 0.1 THEN 'supra-additive'
  WHEN (abs(o) - abs(w)) / greatest(abs(w), 1e-12) < -0.1 THEN 'sub-additive' ELSE 'approximately additive' END AS interaction FROM y""")
def interaction(t):
    arcs = cut(symmetric_arcs(i.plain_graph(t)))
    sources = t.spark.createDataFrame([(s,) for s in REPORT_SOURCES], "id string")
    out = p.interaction(arcs, ["S1", "S2"], sources=sources)
    rounded = [F.when(F.col("metric") == "system_shift_pct", F.round(c, 4)).otherwise(F.round(c, 9)).alias(c) for c in ("expected", "observed", "residual")]
    return out.select("metric", *rounded, "interaction")


@workload("keyed_pagerank", f"""WITH RECURSIVE {i.SQL_PAIRS}, e1 AS (SELECT src, dst, pow(score / 1000.0::DOUBLE, 2) AS weight FROM pairs WHERE score >= 400),
a1 AS MATERIALIZED (SELECT src, dst, weight FROM e1 UNION ALL SELECT dst, src, weight FROM e1),
e2 AS (SELECT src, dst, pow(score / 1000.0::DOUBLE, 2) AS weight FROM pairs WHERE score >= 600),
a2 AS MATERIALIZED (SELECT src, dst, weight FROM e2 UNION ALL SELECT dst, src, weight FROM e2),
{i.sql_pagerank('x', 'a1')},{i.sql_pagerank('y', 'a2')}
SELECT '400' AS threshold, id, round(pagerank, 9) AS pagerank FROM x UNION ALL SELECT '600', id, round(pagerank, 9) FROM y""")
def keyed_pagerank(t):
    arcs = None
    for threshold in (400, 600):
        part = symmetric_arcs(i.plain_graph(t, threshold)).withColumn("threshold", F.lit(str(threshold)))
        arcs = part if arcs is None else arcs.unionByName(part)
    return p.keyed_pagerank(arcs, "threshold", scenarios=[Scenario("base")]).select("threshold", "id", r("pagerank", 9))


@workload("composite_score", """
SELECT p_partkey AS id, round(100 * (0.25 * greatest(0, least(1, (p_size / 50.0::DOUBLE - 0.2::DOUBLE) / 0.61::DOUBLE)) + 0.20 * greatest(0, least(1, (p_retailprice / 20.0::DOUBLE - 26) / 73))
  + 0.20 * CASE WHEN p_size > 0 THEN least(1.0::DOUBLE, log10(p_size + 1) / 3) ELSE 0 END), 6) AS composite_score FROM part""")
def composite_score(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("nds"), (F.col("p_retailprice") / 20.0).alias("mean_plddt"),
                         F.lit(None).cast("double").alias("sasa"), F.col("p_size").alias("num_ligands"))
    return sc.composite_score(rows).select("id", r("composite_score", 6))
