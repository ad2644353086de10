"""What-if scenarios: attenuate edges, compare importance before and after.

A scenario is rows of a table (``scenario_id, id, factor``), not a mutated graph.
All scenarios of a call run in one batched PageRank; only the arcs they touch
are written as overrides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshflux.functions.inference import benjamini_hochberg
from meshflux.functions.measures import direction, hill_survival, neighbour_boost, percent_change
from meshflux.functions.ordering import quantiles, row_numbers
from meshflux.operators import residual, traversal
from meshflux.operators.edges import suppressed
from meshflux.operators.propagation import Scenario, pagerank, symmetric_arcs
from meshflux.session import cut
from meshflux.settings import (
    BLOCK_FRACTION, DAMPING, DOSE_DAMPING, DOSES, FDR_ALPHA, HILL_EXPONENT, NEIGHBOUR_BOOST, NEIGHBOUR_SCORE_MIN, PRESET_ITERATIONS,
    SEED, SELECTION_PERCENTILE, SELECTION_TOP_N,
)

BASE = "base"
#: Survival below which an edge grows no longer.
LEAST_SURVIVAL = 1e-6
#: Two changes this close are the same change.
NULL_SLACK = 2.220446049250313e-16


def scenario_table(spark, targets: dict[str, Sequence[str]], factor: float | dict[str, float] = BLOCK_FRACTION) -> DataFrame:
    """``scenario_id, id, factor`` from a mapping of scenario name to target ids."""
    rows = [
        (name, str(target), float(factor[name] if isinstance(factor, dict) else factor))
        for name, ids in targets.items() for target in dict.fromkeys(ids)
    ]
    return spark.createDataFrame(rows, "scenario_id string, id string, factor double")


def overrides_for(arcs: DataFrame, scenarios: DataFrame, *, mode: str = "incident") -> DataFrame:
    """New weights of the arcs a scenario touches; a shared arc is scaled once."""
    out = arcs.join(scenarios.withColumnRenamed("id", "src"), "src").select("scenario_id", "src", "dst", "weight", "factor")
    into = arcs.join(scenarios.withColumnRenamed("id", "dst"), "dst").select("scenario_id", "src", "dst", "weight", "factor")
    touched = {"incident": out.unionByName(into), "outgoing": out, "incoming": into}[mode]
    return touched.groupBy("scenario_id", "src", "dst").agg((F.max("weight") * F.min("factor")).alias("weight"))


def compare(ranks: DataFrame, *, base: str = BASE, bases: DataFrame | None = None) -> DataFrame:
    """Baseline and perturbed rank per scenario and node, with delta and direction.

    ``bases(scenario_id, base_id)`` names a baseline per scenario when they differ.
    """
    if bases is None:
        before = ranks.where(F.col("scenario_id") == base).select("id", F.col("pagerank").alias("baseline"))
        joined = ranks.where(F.col("scenario_id") != base).join(before, "id")
    else:
        before = ranks.select(F.col("scenario_id").alias("base_id"), "id", F.col("pagerank").alias("baseline"))
        joined = ranks.join(bases, "scenario_id").join(before, ["base_id", "id"])
    delta = F.col("pagerank") - F.col("baseline")
    return joined.select(
        "scenario_id", "id", "baseline", F.col("pagerank").alias("perturbed"), delta.alias("delta"),
        percent_change("baseline", "pagerank", undefined=None).alias("delta_pct"),
        F.abs(delta).alias("abs_delta"), direction(delta).alias("direction"),
    )


def what_if(
    arcs: DataFrame, scenarios: DataFrame, *, damping: float = DAMPING, mode: str = "incident",
    symmetric: bool = True, tolerance: float = 1e-11,
) -> DataFrame:
    """Response of every node in every scenario (see ``compare``).

    Weakening one direction only leaves the arcs without symmetry, so those
    modes are solved by plain iteration.
    """
    symmetric = symmetric and mode == "incident"
    names = [r[0] for r in scenarios.select("scenario_id").distinct().orderBy("scenario_id").collect()]
    ranks = pagerank(
        arcs, scenarios=[Scenario(BASE, damping)] + [Scenario(n, damping) for n in names],
        overrides=overrides_for(arcs, scenarios, mode=mode), symmetric=symmetric, tolerance=tolerance,
    )
    return compare(cut(ranks))


def what_if_changes(arcs: DataFrame, scenarios: DataFrame, *, damping: float = DAMPING, tolerance: float = 1e-11) -> tuple[DataFrame, DataFrame]:
    """Base ranks ``id, pagerank`` and the deltas ``scenario_id, id, delta`` of normalised ranks, by residuals.

    Only nodes that move have rows. Without dangling nodes the sum of ranks stays
    1 and a delta is the solver's own; otherwise all ranks of a scenario are
    scaled, and every node gets a row.
    """
    base, moved = residual.deltas(arcs, overrides_for(arcs, scenarios), damping=damping, tolerance=tolerance)
    sums = cut(moved.groupBy("scenario_id").agg((F.lit(1.0) + F.sum("delta")).alias("scale")))
    if sums.where(F.abs(F.col("scale") - 1) > 1e-9).isEmpty():
        return base, moved
    every = base.join(F.broadcast(sums)).join(moved, ["scenario_id", "id"], "left").fillna(0.0, ["delta"])  # one row a scenario
    scaled = (F.col("pagerank") + F.col("delta")) / F.col("scale") - F.col("pagerank")
    return base, every.select("scenario_id", "id", scaled.alias("delta"))


def what_if_by_residuals(arcs: DataFrame, scenarios: DataFrame, **options) -> DataFrame:
    """``what_if`` from the base solution and the residuals of the scenarios: the same rows, for many scenarios or small ones."""
    base, moved = what_if_changes(arcs, scenarios, **options)
    names = scenarios.select("scenario_id").distinct()
    every = base.join(F.broadcast(names)).join(moved, ["scenario_id", "id"], "left").fillna(0.0, ["delta"])  # one row a scenario
    rows = every.select("scenario_id", "id", F.col("pagerank").alias("baseline"), (F.col("pagerank") + F.col("delta")).alias("perturbed"), "delta")
    return rows.select("scenario_id", "id", "baseline", "perturbed", "delta", percent_change("baseline", "perturbed", undefined=None).alias("delta_pct"),
                       F.abs("delta").alias("abs_delta"), direction(F.col("delta")).alias("direction"))


def without_targets(responses: DataFrame, scenarios: DataFrame) -> DataFrame:
    return responses.join(scenarios.select("scenario_id", "id").distinct(), ["scenario_id", "id"], "left_anti")


def system_shift(responses: DataFrame) -> DataFrame:
    """Total variation distance, share of moved nodes, and their blend, per scenario."""
    moved = F.avg((F.col("abs_delta") > 1e-6).cast("double")) * 100.0
    tvd = F.sum("abs_delta") / 2.0
    return responses.groupBy("scenario_id").agg(tvd.alias("total_variation"), moved.alias("moved_pct")).withColumn(
        "system_shift_pct", F.col("total_variation") * 100.0 * 0.5 + F.col("moved_pct") * 0.5)


def top_positive_mean(responses: DataFrame, *, top: int = 100) -> DataFrame:
    """Mean of the largest positive percent changes per scenario."""
    gains = responses.where((F.col("direction") == "gain") & F.col("delta_pct").isNotNull())
    order = Window.partitionBy("scenario_id").orderBy(F.desc("delta_pct"), "id")
    best = gains.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    return best.groupBy("scenario_id").agg(F.avg("delta_pct").alias("top_positive_mean_pct"))


def classify(
    responses: DataFrame, *, p_values: DataFrame | None = None, mode: str = "null_fdr", top_n: int = SELECTION_TOP_N,
    percentile: float = SELECTION_PERCENTILE, alpha: float = FDR_ALPHA,
) -> DataFrame:
    """Selected responses of each scenario with the reason for their selection.

    ``null_fdr`` keeps significant rows and an exploratory top-n of the rest,
    ``percentile`` the strong rows, ``top_n`` the largest changes.
    """
    if mode not in ("null_fdr", "percentile", "top_n"):
        raise ValueError("mode must be null_fdr, percentile or top_n")
    if p_values is None:
        rows = responses.withColumn("empirical_p", F.lit(1.0))
    else:
        rows = responses.join(p_values, ["scenario_id", "id"], "left").fillna(1.0, ["empirical_p"])
    rows = cut(benjamini_hochberg(rows, "empirical_p", by=["scenario_id"]))
    limits = quantiles(rows, "abs_delta", {"limit": percentile / 100.0}, by=["scenario_id"]).drop("n")
    rows = rows.join(limits, "scenario_id").withColumns({
        "is_significant": F.col("q_value") <= alpha,
        "is_strong": (F.col("abs_delta") >= F.col("limit")) & (F.col("abs_delta") > 0),
    }).drop("limit")
    if mode == "percentile":
        return rows.where("is_strong").withColumn("reason", F.lit(f">= {percentile:g} percentile of |delta|"))
    ahead = Window.partitionBy("scenario_id").orderBy(F.desc("abs_delta"), "id")
    if mode == "top_n":
        ranked = rows.withColumn("_r", F.row_number().over(
            Window.partitionBy("scenario_id").orderBy(F.desc("is_significant"), F.desc("abs_delta"), "id")))
        return ranked.where(F.col("_r") <= top_n).drop("_r").withColumn("reason", F.lit(f"exploratory top {top_n} |delta|"))
    significant = rows.where("is_significant").withColumn("reason", F.lit(f"empirical null, q <= {alpha:g}"))
    rest = rows.where("NOT is_significant").withColumn("_r", F.row_number().over(ahead)).where(F.col("_r") <= top_n).drop("_r")
    return significant.unionByName(rest.withColumn("reason", F.lit(f"exploratory top {top_n} beyond the null")))


def positive_gains(responses: DataFrame, *, top_n: int = SELECTION_TOP_N, minimum_pct: float = 0.05) -> DataFrame:
    """The largest percent gains above a minimum, per scenario."""
    gains = responses.where((F.col("direction") == "gain") & (F.col("delta_pct") > minimum_pct))
    order = Window.partitionBy("scenario_id").orderBy(F.desc("delta_pct"), "id")
    return gains.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def extremes(responses: DataFrame) -> DataFrame:
    """Strongest gain and strongest loss of each scenario."""
    rows = responses.where(F.col("delta_pct").isNotNull())
    high = F.max(F.struct("delta_pct", "id"))
    low = F.min(F.struct("delta_pct", "id"))
    return rows.groupBy("scenario_id").agg(high.alias("_h"), low.alias("_l")).select(
        "scenario_id", F.col("_h.id").alias("gain_id"), F.col("_h.delta_pct").alias("gain_pct"),
        F.col("_l.id").alias("loss_id"), F.col("_l.delta_pct").alias("loss_pct"))


# --- degree-matched null -----------------------------------------------------

def degree_matched_draws(degrees: DataFrame, targets: Sequence[str], iterations: int, *, seed: int = SEED) -> DataFrame:
    """Random stand-ins for the targets: ``scenario_id, id``, as many per iteration as targets in the graph.

    In each iteration the nodes of a target's log2-degree band stand in a seeded
    hash order, and the targets of the band take the first ones. A band with
    fewer nodes than targets is filled up with the nodes of nearest degree. No
    node is drawn twice in an iteration, and targets never.
    """
    spark = degrees.sparkSession
    wanted = spark.createDataFrame([(t,) for t in dict.fromkeys(targets)], "id string")
    band = F.floor(F.log2(F.greatest(F.lit(1), F.col("degree")).cast("double"))).cast("int")
    rows = cut(degrees.select("id", "degree", band.alias("band")))
    asked = rows.join(wanted, "id")
    needs = {r["band"]: (r["n"], r["degree"]) for r in asked.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("degree").alias("degree")).collect()}  # at most 64 bands
    if not needs:
        return spark.createDataFrame([], "scenario_id string, id string")
    pool = rows.join(wanted, "id", "left_anti")
    have = {r["band"]: r["n"] for r in pool.where(F.col("band").isin(*needs)).groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Candidates: a band's own nodes, and for a short band the nearest ones of other bands, as many as may be asked for.
    total = sum(n for n, _ in needs.values())
    if pool.limit(total).count() < total:
        raise ValueError("the graph has fewer nodes than the draws need")
    chosen = None
    for name, (n, degree) in sorted(needs.items()):
        own = pool.where(F.col("band") == name).select("id", F.lit(0).alias("far"))
        if have.get(name, 0) < n:
            near = pool.where(F.col("band") != name).orderBy(F.abs(F.col("degree") - F.lit(degree)), "degree", "id").limit(total)
            place = F.row_number().over(Window.orderBy(F.abs(F.col("degree") - F.lit(degree)), "degree", "id"))  # at most as many rows as targets
            own = own.unionByName(near.select("id", place.alias("far")))
        own = own.withColumn("band", F.lit(name))
        chosen = own if chosen is None else chosen.unionByName(own)
    chosen = cut(chosen)
    grid = spark.range(1, iterations + 1).select(F.col("id").cast("int").alias("iteration"))
    # Per iteration and band only the first nodes of the hash order count, so each partition keeps a few rows before the shuffle.
    short = [b for b, (n, _) in needs.items() if have.get(b, 0) < n]
    quota = F.coalesce(*[F.when(F.col("band") == b, n) for b, (n, _) in needs.items()])
    order = [F.asc("far"), F.xxhash64("id", "iteration", F.lit(seed)), F.asc("id")]
    every = chosen.where(~F.col("band").isin(*short)) if short else chosen
    first = F.row_number().over(Window.partitionBy("iteration", "band").orderBy(*order))
    draws = every.join(F.broadcast(grid)).withColumn("place", first).where(F.col("place") <= quota).select("iteration", "id")  # one row an iteration
    for b in short:
        # Bands that are short give all they have and nearest nodes nobody else drew; the counts are those of the targets.
        free = chosen.where(F.col("band") == b).join(F.broadcast(grid)).join(draws, ["iteration", "id"], "left_anti")
        more = free.withColumn("place", F.row_number().over(Window.partitionBy("iteration").orderBy(*order))).where(F.col("place") <= needs[b][0])
        draws = draws.unionByName(more.select("iteration", "id"))
    return draws.select(F.format_string("null_%04d", "iteration").alias("scenario_id"), "id")


def null_p_values(
    arcs: DataFrame, observed: DataFrame, targets: Sequence[str], *, factor: float = BLOCK_FRACTION,
    damping: float = DAMPING, iterations: int = PRESET_ITERATIONS["fast"], seed: int = SEED, tolerance: float = 1e-11,
) -> DataFrame:
    """Empirical p per node: share of degree-matched draws that move it at least as far.

    ``observed(scenario_id, id, abs_delta)``. Without iterations every p is 1.
    """
    if iterations <= 0:
        return observed.select("scenario_id", "id", F.lit(1.0).alias("empirical_p"))
    degrees = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    draws = cut(degree_matched_draws(degrees, targets, iterations, seed=seed))
    sizes = draws.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"))
    asked = degrees.join(arcs.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(targets)], "id string"), "id").count()
    if sizes.where((F.col("n") == asked) & (F.col("d") == asked)).count() != (iterations if asked else 0):
        raise ValueError("a draw holds another number of nodes than there are targets")
    moved = what_if_changes(arcs, draws.withColumn("factor", F.lit(float(factor))), damping=damping, tolerance=tolerance)[1]
    seen = observed.select("scenario_id", "id", F.col("abs_delta").alias("seen"))
    # A node that a draw leaves where it is has no row: such draws reach only what did not move either.
    nulls = moved.select("id", F.abs("delta").alias("null_delta"))
    least = F.col("seen") - F.lit(NULL_SLACK)
    counts = seen.join(nulls, "id", "left").groupBy("scenario_id", "id", "seen").agg(
        F.count_if(F.col("null_delta") >= least).alias("reached"), F.count("null_delta").alias("rows"))
    reached = F.col("reached") + F.when(least <= 0, F.lit(iterations) - F.col("rows")).otherwise(0)
    return counts.select("scenario_id", "id", ((reached + 1) / F.lit(iterations + 1.0)).alias("empirical_p"))


# --- families of scenarios ---------------------------------------------------

def what_if_report(arcs: DataFrame, scenarios: DataFrame, *, sample: int | None = None, sources: DataFrame | None = None, damping: float = DAMPING) -> DataFrame:
    """One row per scenario: system shift, and global efficiency before and after from ``sources``, ``sample`` hashed ones, or all."""
    shift = system_shift(cut(what_if_by_residuals(arcs, scenarios, damping=damping)))
    efficiency = scenario_efficiency(arcs, scenarios, sample=sample, sources=sources).select(
        "scenario_id", F.col("baseline").alias("efficiency_before"), F.col("perturbed").alias("efficiency_after"), F.col("change_pct").alias("efficiency_change_pct"))
    return shift.join(efficiency, "scenario_id")


def severity_sweep(
    arcs: DataFrame, targets: Sequence[str], fractions: dict[str, float], *, damping: float = DAMPING, sample: int | None = None, sources: DataFrame | None = None
) -> DataFrame:
    """Burden, strong responses, system shift and change of global efficiency for each attenuation level; efficiency as in ``scenario_efficiency``."""
    table = scenario_table(arcs.sparkSession, {n: targets for n in fractions}, fractions)
    responses = cut(without_targets(what_if(arcs, table, damping=damping), table))
    strong = quantiles(responses, "abs_delta", {"limit": SELECTION_PERCENTILE / 100.0}, by=["scenario_id"]).drop("n")
    rated = responses.join(strong, "scenario_id").groupBy("scenario_id").agg(
        F.sum("abs_delta").alias("burden"),
        F.count_if((F.col("abs_delta") >= F.col("limit")) & (F.col("abs_delta") > 0)).alias("strong_responses"))
    efficiency = scenario_efficiency(arcs, table, sample=sample, sources=sources).select("scenario_id", F.col("change_pct").alias("efficiency_change_pct"))
    return rated.join(system_shift(responses).select("scenario_id", "system_shift_pct"), "scenario_id").join(efficiency, "scenario_id")


def interaction(
    arcs: DataFrame, targets: Sequence[str], *, sample: int | None = None, sources: DataFrame | None = None, factor: float = BLOCK_FRACTION, tolerance: float = 0.10
) -> DataFrame:
    """Combined effect against the sum of the single effects, per metric; efficiency as in ``scenario_efficiency``."""
    unique = list(dict.fromkeys(targets))
    if len(unique) < 2:
        raise ValueError("an interaction needs at least two targets")
    sets = {f"single_{t}": [t] for t in unique} | {"combined": unique}
    table = scenario_table(arcs.sparkSession, sets, factor)
    responses = cut(what_if(arcs, table))
    shift = system_shift(responses).select("scenario_id", F.lit("system_shift_pct").alias("metric"), F.col("system_shift_pct").alias("effect"))
    efficiency = scenario_efficiency(arcs, table, sample=sample, sources=sources).select("scenario_id", F.lit("global_efficiency_change").alias("metric"), F.col("change").alias("effect"))
    both = shift.unionByName(efficiency)
    rated = both.groupBy("metric").agg(
        F.sum(F.when(F.col("scenario_id") != "combined", F.col("effect"))).alias("expected"),
        F.max(F.when(F.col("scenario_id") == "combined", F.col("effect"))).alias("observed"))
    return rated.withColumns({
        "residual": F.col("observed") - F.col("expected"), "interaction": additivity("observed", "expected", tolerance)})


def additivity(observed: str, expected: str, tolerance: float):
    ratio = (F.abs(observed) - F.abs(expected)) / F.greatest(F.abs(expected), F.lit(1e-12))
    return F.when(ratio > tolerance, "supra-additive").when(ratio < -tolerance, "sub-additive").otherwise("approximately additive")


def scenario_arcs(arcs: DataFrame, scenarios: DataFrame, *, mode: str = "incident") -> DataFrame:
    """Arcs of every scenario with the baseline: ``scenario_id, src, dst, weight, distance``."""
    names = [BASE] + [r[0] for r in scenarios.select("scenario_id").distinct().orderBy("scenario_id").collect()]
    changed = overrides_for(arcs, scenarios, mode=mode).withColumnRenamed("weight", "new_weight")
    every = arcs.select("src", "dst", "weight", F.explode(F.array(*[F.lit(n) for n in names])).alias("scenario_id"))
    joined = every.join(changed, ["scenario_id", "src", "dst"], "left")
    weight = F.coalesce("new_weight", "weight")
    from meshflux.functions.measures import strength_to_distance
    return joined.select("scenario_id", "src", "dst", weight.alias("weight"), strength_to_distance(weight).alias("distance"))


def scenario_efficiency(arcs: DataFrame, scenarios: DataFrame, *, sample: int | None = None, sources: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """Global efficiency of every scenario against the baseline, from the same ``sources(id)``, ``sample`` hashed ones, or all."""
    keyed = scenario_arcs(arcs, scenarios)
    nodes = traversal.vertices_of(keyed, "scenario_id")
    picked = traversal.sample_ids(traversal.vertices_of(arcs), sample, seed) if sources is None else sources.select("id").distinct()
    sources = cut(nodes.join(picked, "id", "left_semi").withColumnRenamed("id", "source"))
    found = traversal.shortest_distances(keyed, sources, by=["scenario_id"])
    rated = cut(traversal.efficiency_of(found, sources, nodes, by=["scenario_id"]))
    base = rated.where(F.col("scenario_id") == BASE).select(F.col("efficiency").alias("baseline"))
    return rated.where(F.col("scenario_id") != BASE).join(F.broadcast(base)).select(  # one row
        "scenario_id", "baseline", F.col("efficiency").alias("perturbed"),
        (F.col("efficiency") - F.col("baseline")).alias("change"),
        percent_change("baseline", "efficiency").alias("change_pct"))


def batch_sweep(arcs: DataFrame, scores: DataFrame, *, top_n: int, factor: float = BLOCK_FRACTION) -> DataFrame:
    """One scenario per top-scored node, one result row each, most disruptive first."""
    best = scores.orderBy(F.desc("importance"), "id").limit(top_n)
    table = cut(best.select(F.col("id").alias("scenario_id"), "id", F.lit(float(factor)).alias("factor")))
    responses = cut(what_if_by_residuals(arcs, table))
    out = system_shift(responses).join(extremes(without_targets(responses, table)), "scenario_id")
    return out.orderBy(F.desc("system_shift_pct"), "scenario_id")


def compensation(responses: DataFrame, scores: DataFrame, *, top: int = 25) -> DataFrame:
    """The first gains of each scenario with their baseline scores."""
    return positive_gains(responses, top_n=top).join(scores, "id", "left")


def dose_response(
    edges: DataFrame, targets: Sequence[str], *, doses: Sequence[float] = DOSES, exponent: float = HILL_EXPONENT,
    boost: float = NEIGHBOUR_BOOST, score_min: float = NEIGHBOUR_SCORE_MIN, damping: float = DOSE_DAMPING,
    tolerance: float = 1e-11,
) -> DataFrame:
    """Restart-walk signal kept by the targets at each surviving fraction.

    Edges of a target follow the Hill curve; edges of its strong neighbours get
    a boost that grows with the inhibition. Distances follow the new weights.
    """
    spark = edges.sparkSession
    arcs = cut(symmetric_arcs(edges))
    overrides = cut(dose_overrides(arcs, targets, doses=doses, exponent=exponent, boost=boost, score_min=score_min))
    ids = spark.createDataFrame([(t,) for t in dict.fromkeys(targets)], "id string")
    seeds = ids.join(traversal.vertices_of(arcs), "id", "left_semi").withColumn("mass", F.lit(1.0))
    names = [dose_name(d) for d in sorted(doses, reverse=True)]
    ranks = pagerank(
        arcs, scenarios=[Scenario(n, damping) for n in [BASE, *names]], overrides=overrides.select("scenario_id", "src", "dst", "weight"),
        restart=seeds, tolerance=tolerance)
    signal = cut(ranks.join(ids, "id", "left_semi").groupBy("scenario_id").agg(F.sum("pagerank").alias("signal")))
    base = signal.where(F.col("scenario_id") == BASE).select(F.col("signal").alias("baseline_signal"))
    counts = overrides.where("src < dst").groupBy("scenario_id").agg(
        F.count_if(F.col("kind") == "target").alias("suppressed_edges"), F.count_if(F.col("kind") == "neighbour").alias("boosted_edges"))
    grid = spark.createDataFrame([(dose_name(d), float(d)) for d in doses], "scenario_id string, survival double")
    lost = (F.col("baseline_signal") - F.col("signal")) / F.col("baseline_signal") * 100.0
    return grid.join(signal, "scenario_id").join(F.broadcast(base)).join(counts, "scenario_id", "left").select(  # one row
        "survival", F.round((1.0 - F.col("survival")) * 100.0, 1).alias("inhibition_pct"),
        neighbour_boost("survival", boost).alias("boost"), "suppressed_edges", "boosted_edges",
        "baseline_signal", "signal", F.when(F.col("baseline_signal") > 0, lost).otherwise(0.0).alias("loss_pct"))


def dose_stress(
    edges: DataFrame, targets: Sequence[str], *, seeds: DataFrame | None = None, hops: int = 3, sources: DataFrame | None = None,
    sample: int | None = None, doses: Sequence[float] = DOSES, top: int | None = 5,
) -> DataFrame:
    """Per dose the ``top`` nodes that gain most betweenness: ``survival, rank, id, before, after, delta``.

    A dose makes the edges of the targets longer, to distance / survival; a boost
    is one of weights and leaves lengths alone. Lengths are the column
    ``distance``, or follow the weights. Only nodes within ``hops`` of ``seeds(id)``
    are rated (all without seeds), over the shortest paths from ``sources(id)``,
    from ``sample`` hashed ones, or from every node. Gains are compared to six
    digits, ties go by id. Targets outside the graph change nothing, and a dose
    without gains has no rows.
    """
    from meshflux.functions.measures import strength_to_distance
    from meshflux.operators.centrality import betweenness

    spark = edges.sparkSession
    if "distance" not in edges.columns:
        edges = edges.withColumn("distance", strength_to_distance("weight"))
    arcs = cut(symmetric_arcs(edges, "distance"))
    ids = spark.createDataFrame([(t,) for t in dict.fromkeys(targets)], "id string")
    ends = [F.broadcast(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))) for end in ("src", "dst")]  # the call's targets
    marked = arcs.join(ends[0], "src", "left").join(ends[1], "dst", "left")
    states = F.array(*[F.struct(F.lit(n).alias("scenario_id"), F.lit(float(d)).alias("survival")) for n, d in [(BASE, 1.0), *((dose_name(d), d) for d in doses)]])
    hit = F.col("_src").isNotNull() | F.col("_dst").isNotNull()
    keyed = marked.select("src", "dst", "distance", hit.alias("hit"), F.explode(states).alias("_s")).select(
        "_s.scenario_id", "src", "dst",
        F.when(F.col("hit"), F.col("distance") / F.greatest(F.col("_s.survival"), F.lit(LEAST_SURVIVAL))).otherwise(F.col("distance")).alias("distance"))
    if sources is not None:
        known = sources.join(traversal.vertices_of(arcs), "id", "left_semi").select("id").distinct()
        names = F.explode(F.array(*[F.lit(n) for n in [BASE, *map(dose_name, doses)]])).alias("scenario_id")
        sources = known.select(names, "id")
    rated = betweenness(keyed, sample=sample, sources=sources, by=["scenario_id"])
    if seeds is not None:
        rated = rated.join(traversal.neighbourhood(arcs, seeds, hops=hops).select("id"), "id", "left_semi")
    rated = cut(rated)
    base = rated.where(F.col("scenario_id") == BASE).select("id", F.col("betweenness").alias("unchanged"))
    grid = spark.createDataFrame([(dose_name(d), float(d)) for d in doses], "scenario_id string, survival double")
    gain = F.round(F.col("betweenness") - F.col("unchanged"), 6)
    rows = rated.join(F.broadcast(grid), "scenario_id").join(base, "id").select(  # one row a dose
        "survival", "id", "unchanged", "betweenness", gain.alias("delta")).where("delta > 0")
    if top is None:
        best = row_numbers(rows, [F.desc("delta"), F.col("id")], name="rank", by=["survival"])
    else:
        order = Window.partitionBy("survival").orderBy(F.desc("delta"), "id")
        best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("survival", F.col("rank").cast("long").alias("rank"), "id", F.col("unchanged").alias("before"), F.col("betweenness").alias("after"), "delta")


def dose_report(
    edges: DataFrame, targets: Sequence[str], *, seeds: DataFrame | None = None, hops: int = 3, sources: DataFrame | None = None,
    sample: int | None = None, doses: Sequence[float] = DOSES, exponent: float = HILL_EXPONENT, boost: float = NEIGHBOUR_BOOST,
    score_min: float = NEIGHBOUR_SCORE_MIN, damping: float = DOSE_DAMPING, top: int = 5,
) -> DataFrame:
    """``dose_response`` with ``stressed``, the ids of ``dose_stress`` with the largest gain first, and ``max_congestion``.

    A dose without gains has an empty list and 0.
    """
    table = dose_response(edges, targets, doses=doses, exponent=exponent, boost=boost, score_min=score_min, damping=damping)
    stress = cut(dose_stress(edges, targets, seeds=seeds, hops=hops, sources=sources, sample=sample, doses=doses, top=top))
    lists = stress.groupBy("survival").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("stressed"), F.max("delta").alias("max_congestion"))
    return table.join(lists, "survival", "left").withColumns({
        "stressed": F.coalesce("stressed", F.array().cast("array<string>")), "max_congestion": F.coalesce("max_congestion", F.lit(0.0))})


def dose_name(dose: float) -> str:
    return f"dose_{float(dose):.4f}"


def dose_overrides(arcs, targets, *, doses, exponent, boost, score_min) -> DataFrame:
    """Per dose: Hill weights on target arcs, boosted weights on their neighbours' other arcs."""
    spark = arcs.sparkSession
    ids = spark.createDataFrame([(t,) for t in dict.fromkeys(targets)], "id string")
    grid = F.explode(F.array(*[F.struct(F.lit(dose_name(d)).alias("scenario_id"), F.lit(float(d)).alias("survival")) for d in doses]))
    touching = arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(
        arcs.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(arcs.columns)).distinct()
    hit = touching.select("src", "dst", "weight", grid.alias("_d")).select(
        "_d.scenario_id", "src", "dst", hill_survival("weight", "_d.survival", exponent).alias("weight"), F.lit("target").alias("kind"))
    strong = arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").where(
        F.lit(1000.0) * F.sqrt(F.greatest("weight", F.lit(0.0))) >= score_min).select(F.col("dst").alias("id")).distinct()
    near = arcs.join(strong.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(
        arcs.join(strong.withColumnRenamed("id", "dst"), "dst", "left_semi").select(arcs.columns)).distinct()
    near = near.join(touching, ["src", "dst"], "left_anti")
    factor = neighbour_boost("_d.survival", boost)
    lifted = near.select("src", "dst", "weight", grid.alias("_d")).where(factor > 0.001).select(
        "_d.scenario_id", "src", "dst", (F.col("weight") * (1.0 + factor)).alias("weight"), F.lit("neighbour").alias("kind"))
    return hit.unionByName(lifted)


def half_loss_dose(doses: DataFrame, *, level: float = 50.0) -> DataFrame:
    """Surviving fraction at which ``level`` percent of the signal is lost.

    Doses run from weak to strong inhibition; the first crossing is interpolated.
    ``status`` is ``sensitive`` if the weakest dose already loses more,
    ``resistant`` if no dose loses that much.
    """
    order = Window.orderBy(F.desc("survival"))  # one row per dose
    rows = doses.select(
        "survival", "loss_pct", F.lead("survival").over(order).alias("next_survival"),
        F.lead("loss_pct").over(order).alias("next_loss"), F.row_number().over(order).alias("place"))
    crosses = (F.col("loss_pct") <= level) & (F.col("next_loss") >= level)
    part = (F.lit(level) - F.col("loss_pct")) / (F.col("next_loss") - F.col("loss_pct") + F.lit(1e-12))
    at = F.col("survival") + part * (F.col("next_survival") - F.col("survival"))
    summary = rows.agg(
        F.max(F.when((F.col("place") == 1) & (F.col("loss_pct") > level), F.col("survival"))).alias("first"),
        F.min_by(F.when(crosses, at), F.when(crosses, F.col("place"))).alias("crossing"))
    return summary.select(
        F.coalesce("first", "crossing").alias("half_loss_survival"),
        F.when(F.col("first").isNotNull(), "sensitive").when(F.col("crossing").isNotNull(), "interpolated").otherwise("resistant").alias("status"))


def keyed_pagerank(arcs: DataFrame, key: str, *, scenarios: Sequence[Scenario], overrides: DataFrame | None = None, tolerance: float = 1e-11) -> DataFrame:
    """PageRank of many separate graphs at once: ``scenario_id, key, id, pagerank``.

    The graphs share no node once the key is part of the id, so one run solves
    them all and each is normalised on its own.
    """
    glue = lambda c: F.concat_ws("\u0001", F.col(key).cast("string"), F.col(c))
    joined = arcs.select(glue("src").alias("src"), glue("dst").alias("dst"), "weight")
    own = None
    if overrides is not None:
        own = overrides.select("scenario_id", glue("src").alias("src"), glue("dst").alias("dst"), "weight")
    ranks = pagerank(joined, scenarios=scenarios, overrides=own, tolerance=tolerance)
    split = F.split("id", "\u0001")
    rows = ranks.select("scenario_id", F.get(split, F.lit(0)).alias(key), F.get(split, F.lit(1)).alias("id"), "pagerank")
    totals = rows.groupBy("scenario_id", key).agg(F.sum("pagerank").alias("_mass"))
    return rows.join(totals, ["scenario_id", key]).withColumn("pagerank", F.col("pagerank") / F.col("_mass")).drop("_mass")


def context_differential(arcs: DataFrame, targets: Sequence[str], *, factor: float = BLOCK_FRACTION, percentile: float = SELECTION_PERCENTILE) -> DataFrame:
    """The same scenario in every context: critical responses, and in how many contexts.

    ``arcs(context, src, dst, weight)``. A context without any target is left out.
    """
    spark = arcs.sparkSession
    arcs = cut(arcs.select("context", "src", "dst", "weight"))
    ids = spark.createDataFrame([(t,) for t in dict.fromkeys(targets)], "id string")
    here = cut(traversal.vertices_of(arcs, "context").join(ids, "id", "left_semi"))
    arcs = cut(arcs.join(here.select("context").distinct(), "context", "left_semi"))
    out = arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(arcs.columns)
    into = arcs.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(arcs.columns)
    changed = out.unionByName(into).distinct().select(
        F.lit("hit").alias("scenario_id"), "context", "src", "dst", (F.col("weight") * F.lit(factor)).alias("weight"))
    ranks = cut(keyed_pagerank(arcs, "context", scenarios=[Scenario(BASE), Scenario("hit")], overrides=changed))
    before = ranks.where(F.col("scenario_id") == BASE).select("context", "id", F.col("pagerank").alias("baseline"))
    after = ranks.where(F.col("scenario_id") == "hit").select("context", "id", F.col("pagerank").alias("perturbed"))
    delta = F.col("perturbed") - F.col("baseline")
    rows = cut(before.join(after, ["context", "id"]).join(ids, "id", "left_anti").select(
        "context", "id", delta.alias("delta"), percent_change("baseline", "perturbed", undefined=None).alias("delta_pct"),
        F.abs(delta).alias("abs_delta"), direction(delta).alias("direction")))
    limits = quantiles(rows, "abs_delta", {"limit": percentile / 100.0}, by=["context"]).drop("n")
    critical = cut(rows.join(limits, "context").where((F.col("abs_delta") >= F.col("limit")) & (F.col("abs_delta") > 0)).drop("limit"))
    contexts = here.select("context").distinct().agg(F.count(F.lit(1)).alias("context_total"))
    counts = critical.groupBy("id").agg(F.countDistinct("context").alias("contexts"))
    kind = F.when(F.col("contexts") == F.col("context_total"), "conserved").otherwise("context_specific")
    return critical.join(counts, "id").join(F.broadcast(contexts)).withColumn("response_type", kind).drop("context_total")  # one row


#: Members in one word of a bitmap.
WORD = 64


def context_overlap(members: DataFrame, contexts: Sequence[str] | None = None) -> DataFrame:
    """Members, shared members, union and Jaccard of every pair of contexts (of all without ``contexts``).

    Members are numbered, and a context is a bitmap of 64-bit words: rows that
    meet are words, not ids, and every pair is counted before the shuffle. Contexts
    themselves are few, as they are named by the caller or by an atlas; pairs
    follow their order. Repeated rows count once; null ids and contexts never.
    """
    spark = members.sparkSession
    rows = members.select("context", "id").where("context IS NOT NULL AND id IS NOT NULL")
    if contexts is None:
        names = sorted(r[0] for r in rows.select("context").distinct().collect())
    else:
        names = list(dict.fromkeys(contexts))
    places = spark.createDataFrame(list(enumerate(names)), "place int, context string")
    rows = rows.join(F.broadcast(places), "context")  # one row a context
    numbers = cut(rows.select("id").distinct().withColumn("number", F.monotonically_increasing_id()))
    bit, word = F.expr(f"shiftleft(1L, CAST(number % {WORD} AS INT))"), F.expr(f"number DIV {WORD}")
    words = cut(rows.join(numbers, "id").groupBy(word.alias("word"), "place").agg(F.bit_or(bit).alias("bits")))
    sizes = {r["place"]: r["n"] for r in words.groupBy("place").agg(F.sum(F.bit_count("bits")).alias("n")).collect()}
    other = words.select("word", F.col("place").alias("place_b"), F.col("bits").alias("bits_b"))
    both = words.join(other, (words["word"] == other["word"]) & (F.col("place") < F.col("place_b")))
    shared = both.groupBy("place", "place_b").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("bits_b")))).alias("shared"))
    pairs = [(a, b, names[a], names[b], sizes.get(a, 0), sizes.get(b, 0)) for a in range(len(names)) for b in range(a + 1, len(names))]
    every = spark.createDataFrame(pairs, "place int, place_b int, context_a string, context_b string, members_a long, members_b long")
    counted = every.join(F.broadcast(shared), ["place", "place_b"], "left").fillna(0, ["shared"])  # one row a pair of contexts
    union = F.col("members_a") + F.col("members_b") - F.col("shared")
    return counted.select("context_a", "context_b", "members_a", "members_b", "shared", union.alias("union"), F.try_divide(F.col("shared").cast("double"), union.cast("double")).alias("jaccard"))


def focus(arcs: DataFrame, targets: Sequence[str], *, factor: float = BLOCK_FRACTION) -> DataFrame:
    """Arcs with the targets' edges attenuated, for one-off graph measures."""
    ids = arcs.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(targets)], "id string")
    return suppressed(arcs, ids, factor)
