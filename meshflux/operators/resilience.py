"""Communities, rewiring, threshold sweeps, knock-outs, rescue of weak nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshflux.functions.inference import correlations
from meshflux.functions.measures import normal_tail

from meshflux.operators.centrality import betweenness
from meshflux.operators.edges import simplify
from meshflux.operators.propagation import Scenario, pagerank, symmetric_arcs
from meshflux.operators.scores import importance
from meshflux.operators.traversal import components, largest_component, vertices_of
from meshflux.session import Lineage, cut
from meshflux.settings import NULL_ITERATIONS, NULL_Z, RESCUE_THRESHOLDS, SEED, SWEEP_THRESHOLDS, TIER_TOP


# --- communities -------------------------------------------------------------

def communities(edges: DataFrame) -> DataFrame:
    """Community per node by synchronous modularity moves and contraction.

    In a round a community is either left or entered, so no two nodes swap places,
    and of the moves only those are made whose gains hold together: every round
    raises the modularity. Ties go to the least community id. Where that allows no
    move, those are made no two of which touch the same community. A level ends when no node wants to move (or
    only by less than the rounding of doubles); the levels end when contraction
    allows no further move.
    """
    lineage = Lineage(edges.sparkSession)
    links = lineage.cut(symmetric_arcs(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    member = lineage.cut(vertices_of(edges).select("id", F.col("id").alias("community")))
    total = links.agg(F.sum("weight")).first()[0]
    if not total:
        return member
    while (moved := _local_moves(lineage, links, total)) is not None:
        member = lineage.cut(member.join(moved.select(F.col("id").alias("community"), F.col("community").alias("_to")), "community")
                             .select("id", F.col("_to").alias("community")))
        to = moved.select(F.col("id").alias("src"), F.col("community").alias("a"))
        into = moved.select(F.col("id").alias("dst"), F.col("community").alias("b"))
        links = lineage.cut(links.join(to, "src").join(into, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")))
    names = member.groupBy("community").agg(F.min("id").alias("name"))
    return member.join(names, "community").select("id", F.col("name").alias("community"))


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row with the modularity and the number of communities."""
    links = symmetric_arcs(edges)
    total = links.agg(F.sum("weight")).first()[0]
    return links_modularity(links, member, total)


def links_modularity(links: DataFrame, member: DataFrame, total: float) -> DataFrame:
    a = member.select(F.col("id").alias("src"), F.col("community").alias("a"))
    b = member.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    per = links.join(a, "src").join(b, "dst").groupBy("a").agg(
        F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total"))
    share = F.col("inside") / F.lit(total) - F.pow(F.col("total") / F.lit(total), F.lit(2.0))
    return per.agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("modularity"), F.count(F.lit(1)).alias("communities"))


def _local_moves(lineage, links, total):
    strength = lineage.cut(links.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")))
    loops = links.where("src = dst").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    links = lineage.cut(links.where("src <> dst"))
    state = lineage.cut(strength.select("id", F.col("id").alias("community"), "k"))
    best, held = None, None
    while True:
        near = links.join(state.select(F.col("id").alias("dst"), "community"), "dst").groupBy(
            F.col("src").alias("id"), "community").agg(F.sum("weight").alias("w"))
        sizes = state.groupBy("community").agg(F.sum("k").alias("size"))
        own = state.withColumnRenamed("community", "own")
        options = near.join(own, "id").unionByName(own.select("id", F.col("own").alias("community"), F.lit(0.0).alias("w"), "own", "k"))
        options = options.groupBy("id", "community").agg(F.sum("w").alias("w"), F.first("own").alias("own"), F.first("k").alias("k")).join(sizes, "community")
        stays = F.col("community") == F.col("own")
        others = F.col("size") - F.when(stays, F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * others / F.lit(total), 12)
        offer = F.struct((-F.col("gain")).alias("order"), "community")
        chosen = options.withColumn("gain", gain).groupBy("id").agg(
            F.min(offer).alias("best"), F.max(F.when(stays, F.col("gain"))).alias("now"),
            F.first("own").alias("own"), F.first("k").alias("k"),
            F.max(F.when(stays, F.col("w") / F.lit(total) - F.col("k") / F.lit(total) * (F.col("size") / F.lit(total)))).alias("share"))
        chosen = lineage.cut(chosen.select(
            "id", "own", "k", "share", F.col("best.community").alias("community"), (-F.col("best.order") - F.col("now")).alias("rise")))
        sums = chosen.agg(F.sum("share").alias("share"), F.count_if(F.col("rise") > 0).alias("wish")).first()
        value = loops / total + sums["share"]
        if best is not None and value <= best:
            state = held  # the gains left are below the rounding of doubles
            break
        lineage.drop(held)
        best, held = value, state
        if not sums["wish"]:
            break
        wish = chosen.where("rise > 0").select("id", "own", "community", "k", "rise")
        moves = lineage.cut(_moves_together(wish, total))
        if moves.isEmpty():
            moves = lineage.cut(_moves_apart(wish).select("id", "community"))
        state = lineage.cut(chosen.join(moves.select("id", F.col("community").alias("_to")), "id", "left").select("id", F.coalesce("_to", "own").alias("community"), "k"))
        lineage.drop(moves)
        lineage.drop(chosen)
    changed = not state.where("id <> community").isEmpty()
    return state.select("id", "community") if changed else None


def _moves_together(wish: DataFrame, total: float) -> DataFrame:
    """Moves ``id, community`` of ``wish(id, own, community, k, rise)`` whose gains hold although they are made at once.

    A community is entered if the moves into it gain more than those out of it, else left, never both.
    Two nodes that leave or enter the same one take at most the product of their strengths over ``total``
    from each other's gain, so a move stays if it gains after what the larger ones before it may take.
    The rows before it are summed as a stream.
    """
    ends = F.array(F.struct(F.col("own").alias("end"), (-F.col("rise")).alias("flow")), F.struct(F.col("community").alias("end"), F.col("rise").alias("flow")))
    flow = wish.select(F.explode(ends).alias("_e")).groupBy("_e.end").agg(F.sum("_e.flow").alias("flow"))
    left, entered = flow.where("flow <= 0").select(F.col("end").alias("own")), flow.where("flow > 0").select(F.col("end").alias("community"))
    rows = wish.join(left, "own", "left_semi").join(entered, "community", "left_semi")
    order = [F.desc("rise"), F.asc("id")]
    before = lambda end: F.coalesce(F.sum("k").over(Window.partitionBy(end).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_left", before("own")).withColumn("_entered", before("community"))
    return rows.where(F.col("rise") > F.col("k") * (F.col("_left") + F.col("_entered")) / F.lit(total)).select("id", "community")


def _moves_apart(moves: DataFrame) -> DataFrame:
    """The moves that are the best of both communities they touch: ``id, own, community, rise`` without two that share one."""
    order = F.struct((-F.col("rise")).alias("order"), "id")
    ends = moves.select(F.explode(F.array("own", "community")).alias("end"), order.alias("move"))
    first = ends.groupBy("end").agg(F.min("move").alias("move"))
    twice = first.groupBy(F.col("move.id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return moves.join(twice, "id", "left_semi")


# --- rewiring ----------------------------------------------------------------

#: Rounds without an exchange after which a rewiring is held to be impossible.
STALLED = 25


def rewire(edges: DataFrame, swaps: int, *, seed: int = SEED) -> DataFrame:
    """Degree-preserving rewiring by ``swaps`` endpoint exchanges.

    Edges meet by a seeded hash, two per bucket. An exchange that would make a
    loop or a pair that exists already is refused; weights travel with the edge.
    Raises when the graph does not allow as many exchanges.
    """
    lineage = Lineage(edges.sparkSession)
    columns = [c for c in edges.columns if c not in ("src", "dst")]
    state = lineage.cut(edges.select("src", "dst", *columns))
    total, done, turn, idle = state.count(), 0, 0, 0
    while done < swaps:
        turn += 1
        if total < 2 or idle >= STALLED:
            raise ValueError(f"only {done} of {swaps} exchanges are possible")
        buckets = max(1, min(total // 2, (swaps - done) * 2))
        code = F.xxhash64("src", "dst", F.lit(seed), F.lit(turn))
        row = F.struct(code.alias("code"), "src", "dst", *columns)
        # A bucket keeps only its least and greatest row, so no group is collected.
        pairs = state.groupBy(F.pmod(code, F.lit(buckets)).alias("bucket")).agg(
            F.min(row).alias("x"), F.max(row).alias("y"), F.count(F.lit(1)).alias("n")).where("n >= 2")
        fresh = pairs.select("bucket", "x", "y", F.array(
            F.struct(F.col("x.src").alias("s"), F.col("y.dst").alias("d"), *[F.col(f"x.{c}").alias(c) for c in columns]),
            F.struct(F.col("y.src").alias("s"), F.col("x.dst").alias("d"), *[F.col(f"y.{c}").alias(c) for c in columns])).alias("made"))
        made = fresh.select("bucket", F.posexplode("made").alias("half", "m")).select(
            "bucket", "half", F.col("m.s").alias("src"), F.col("m.d").alias("dst"), *[F.col(f"m.{c}").alias(c) for c in columns])
        made = lineage.cut(made.withColumns({"_a": F.least("src", "dst"), "_b": F.greatest("src", "dst")}))
        taken = state.select(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).distinct()
        clash = made.join(taken, ["_a", "_b"], "left_semi").select("bucket").unionByName(made.where("_a = _b").select("bucket"))
        # Of two exchanges that make the same pair only the one in the least bucket stays.
        first = made.groupBy("_a", "_b").agg(F.min("bucket").alias("first"))
        twice = made.join(first, ["_a", "_b"]).where("bucket <> first").select("bucket")
        good = made.join(clash.unionByName(twice).distinct(), "bucket", "left_anti").where(F.col("bucket") >= 0)
        kept = lineage.cut(good.select("bucket", "half", "src", "dst", *columns))
        made_now = kept.select("bucket").distinct().orderBy("bucket").limit(swaps - done)
        kept = lineage.cut(kept.join(made_now, "bucket", "left_semi"))
        count = kept.count() // 2
        if count == 0:
            idle += 1
            continue
        gone = pairs.join(kept.select("bucket").distinct(), "bucket", "left_semi").select(
            F.explode(F.array(F.struct("x.src", "x.dst"), F.struct("y.src", "y.dst"))).alias("g")).select("g.src", "g.dst")
        after = lineage.cut(state.join(gone, ["src", "dst"], "left_anti").unionByName(kept.select("src", "dst", *columns)))
        lineage.drop(state)
        state, done, idle = after, done + count, 0
    return state


def top_set_stability(edges: DataFrame, *, fraction: float = 0.05, seed: int = SEED, least: float = TIER_TOP) -> DataFrame:
    """Jaccard of the top-tier nodes before and after rewiring a share of the edges."""
    from meshflux.functions.inference import set_overlap

    graph = cut(simplify(edges))
    swaps = int(graph.count() * fraction)
    noisy = rewire(graph, swaps, seed=seed)
    both = graph.select(F.lit("before").alias("state"), "src", "dst", "weight").unionByName(
        noisy.select(F.lit("after").alias("state"), "src", "dst", "weight"))
    rated = cut(keyed_importance(cut(both), "state"))
    top = rated.where(F.col("importance") >= least)
    return set_overlap(top.where("state = 'before'"), top.where("state = 'after'"))


def keyed_importance(edges: DataFrame, key: str) -> DataFrame:
    """Importance of the nodes of several graphs in one run: ``key, id, degree, importance``."""
    from meshflux.plans.scenarios import keyed_pagerank

    arcs = cut(symmetric_arcs(edges, "weight", key))
    ranks = keyed_pagerank(arcs, key, scenarios=[Scenario("base")]).drop("scenario_id")
    degrees = arcs.groupBy(F.col(key).cast("string").alias(key), F.col("src").alias("id")).agg(F.countDistinct("dst").alias("degree"))
    rows = ranks.withColumn("pagerank", F.round("pagerank", 11)).join(degrees, [key, "id"])
    return importance(cut(rows), by=[key])


def null_betweenness(edges: DataFrame, observed: DataFrame, *, iterations: int = NULL_ITERATIONS, sample: int | None = None, seed: int = SEED, z_cut: float = NULL_Z) -> DataFrame:
    """z and tail probability of observed betweenness against rewired graphs.

    ``observed(id, betweenness)``. A node without spread in the null gets a null
    z and is flagged ``degenerate``.
    """
    graph = cut(edges.select("src", "dst", "distance"))
    swaps = max(int(graph.count() * 0.10), 10)
    nulls = None
    for turn in range(iterations):
        part = rewire(graph, swaps, seed=seed + turn).withColumn("iteration", F.lit(turn))
        nulls = part if nulls is None else nulls.unionByName(part)
    rated = betweenness(symmetric_arcs(cut(nulls), "distance", "iteration"), sample=sample, seed=seed, by=["iteration"])
    spread = rated.join(observed.select("id"), "id", "left_semi").groupBy("id").agg(
        F.avg("betweenness").alias("null_mean"), F.stddev_pop("betweenness").alias("null_std"))
    z = F.when(F.col("null_std") > 0, (F.col("betweenness") - F.col("null_mean")) / F.col("null_std"))
    return observed.select("id", "betweenness").join(spread, "id", "left").withColumn("z", z).withColumns({
        "p_value": normal_tail("z"), "is_significant": F.coalesce(F.col("z") > z_cut, F.lit(False)),
        "degenerate": F.coalesce(F.col("null_std") == 0, F.lit(True))})


# --- thresholds and knock-outs -----------------------------------------------

def threshold_sweep(interactions: DataFrame, thresholds: Sequence[int] = SWEEP_THRESHOLDS, *, full: bool = False) -> DataFrame:
    """Nodes, edges, largest-component share, mean degree and resilience per score threshold."""
    lowest = min(thresholds)
    levels = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda x: x <= F.col("score"))
    pairs = interactions.where((F.col("score") >= lowest) & (F.col("src") != F.col("dst"))).groupBy(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("score").alias("score"))
    keyed = cut(pairs.select("src", "dst", F.pow(F.col("score") / 1000.0, F.lit(2.0)).alias("weight"), F.explode(levels).alias("threshold")))
    parts = largest_component(components(keyed, by=["threshold"]), by=["threshold"])
    edges = keyed.groupBy("threshold").agg(F.count(F.lit(1)).alias("edges"))
    mean = F.lit(2.0) * F.col("edges") / F.col("nodes")
    rows = parts.join(edges, "threshold").select(
        "threshold", "nodes", "edges", F.col("ratio").alias("largest_ratio"), mean.alias("mean_degree"),
        F.when((F.col("nodes") > 1) & (mean > 0), F.col("ratio") * F.sqrt(mean / F.log(F.col("nodes") + 1.0))).otherwise(0.0).alias("resilience"))
    if not full:
        return rows.withColumn("hubs", F.lit(None).cast("bigint"))
    hubs = keyed_importance(keyed, "threshold").where(F.col("importance") >= TIER_TOP).groupBy(
        F.col("threshold").cast("int").alias("threshold")).agg(F.count(F.lit(1)).alias("hubs"))
    return rows.join(hubs, "threshold", "left").fillna(0, ["hubs"])


def knockout(edges: DataFrame, scores: DataFrame, *, top: int = 10, seed: int = SEED, control: DataFrame | None = None) -> DataFrame:
    """Drop of the largest component when one top node, or a random set, is removed.

    ``scores(id, betweenness)``. The control removes as many nodes at once, drawn
    by a seeded hash, or the ones listed in ``control(id)``.
    """
    graph = cut(edges.select("src", "dst"))
    nodes = cut(vertices_of(graph))
    best = scores.join(nodes, "id", "left_semi").orderBy(F.desc("betweenness"), "id").limit(top)
    random = nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(top) if control is None else nodes.join(control, "id", "left_semi")
    removed = cut(best.select(F.concat(F.lit("hub:"), F.col("id")).alias("removal"), "id").unionByName(
        random.select(F.lit("random").alias("removal"), "id")))
    names = ["none"] + [r[0] for r in removed.select("removal").distinct().orderBy("removal").collect()]
    every = F.explode(F.array(*[F.lit(n) for n in names])).alias("removal")  # at most top + 2 names
    keyed = graph.select("src", "dst", every)
    ends = [removed.select("removal", F.col("id").alias(e)) for e in ("src", "dst")]
    left = keyed.join(ends[0], ["removal", "src"], "left_anti").join(ends[1], ["removal", "dst"], "left_anti")
    alive = nodes.select("id", every).join(removed, ["removal", "id"], "left_anti")
    sizes = cut(largest_component(components(left, vertices=alive, by=["removal"]), by=["removal"]))
    whole = sizes.where("removal = 'none'").select(F.col("largest").alias("whole"))
    return sizes.where("removal <> 'none'").join(F.broadcast(whole)).select(  # one row
        "removal", ((F.col("whole") - F.col("largest")) / F.col("whole") * 100.0).alias("drop_pct"))


def rescue(interactions: DataFrame, edges: DataFrame, seeds: Sequence[str], *, threshold: int, members: DataFrame | None = None,
           lower: Sequence[int] = RESCUE_THRESHOLDS) -> DataFrame:
    """Edges that bring absent seeds into the graph: ``src, dst, weight, distance, is_bridge``.

    A seed takes its best partner from the first lower threshold that offers one.
    A seed without any, or outside the largest component, is bridged to that
    component's best-connected node. ``members`` limits the seeds to a context.
    """
    spark = edges.sparkSession
    nodes = cut(vertices_of(edges))
    asked = spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "id string")
    if members is not None:
        asked = asked.join(members.select("id"), "id", "left_semi")
    absent = cut(asked.join(nodes, "id", "left_anti"))
    steps = sorted({threshold, *lower}, reverse=True)
    step = F.lit(None).cast("int")
    for t in reversed(steps):
        step = F.when(F.col("score") >= t, F.lit(t)).otherwise(step)
    ends = symmetric_arcs(interactions, "score").join(absent.withColumnRenamed("id", "src"), "src", "left_semi")
    offered = ends.withColumn("step", step).where("step IS NOT NULL AND src <> dst")
    partner = offered.groupBy("src").agg(F.min(F.struct((-F.col("step")).alias("s"), (-F.col("score")).alias("o"), "dst")).alias("b")).select(
        F.col("src"), F.col("b.dst").alias("dst"), (-F.col("b.o")).alias("score"))
    strength = lambda s: F.pow(s / F.lit(1000.0), F.lit(2.0))
    found = cut(partner.select("src", "dst", strength(F.col("score")).alias("weight"), F.lit(False).alias("is_bridge")))
    joined = edges.select("src", "dst").unionByName(found.select("src", "dst"))
    member = cut(components(joined, vertices=absent))
    giant = member.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = cut(member.join(giant, "component", "left_semi").select("id"))
    degree = symmetric_arcs(joined).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("degree"))
    hub = degree.join(inside, "id", "left_semi").orderBy(F.desc("degree"), "id").limit(1).select(F.col("id").alias("dst"))
    lost = absent.join(inside, "id", "left_anti")
    bridges = lost.join(F.broadcast(hub)).select(  # one row
        F.col("id").alias("src"), "dst", strength(F.lit(float(threshold))).alias("weight"), F.lit(True).alias("is_bridge"))
    out = found.unionByName(bridges)
    return out.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", (F.lit(1.0) / F.col("weight")).alias("distance"), "is_bridge")


# --- robustness of rankings --------------------------------------------------

def damping_robustness(edges: DataFrame, *, grid: Sequence[float] = (0.75, 0.85, 0.95), reference: float = 0.85, top: int = 100) -> DataFrame:
    """How rankings change over dampings, and the class of the worst of them."""
    from meshflux.functions.ordering import quantiles, row_numbers

    arcs = cut(symmetric_arcs(edges))
    base = min(grid, key=lambda d: abs(d - reference))
    ranks = pagerank(arcs, scenarios=[Scenario(f"{d:.4f}", d) for d in grid])
    placed = cut(row_numbers(ranks.withColumn("value", F.round("pagerank", 12)), [F.desc("value"), F.asc("id")], by=["scenario_id"], name="place"))
    ref = placed.where(F.col("scenario_id") == f"{base:.4f}").select("id", F.col("value").alias("ref_value"), F.col("place").alias("ref_place"))
    pairs = cut(placed.join(ref, "id").withColumn("shift", F.abs(F.col("place") - F.col("ref_place")).cast("double")))
    shifts = quantiles(pairs, "shift", {"median_shift": 0.5, "p95_shift": 0.95, "max_shift": 1.0}, by=["scenario_id"]).drop("n")
    shared = pairs.groupBy("scenario_id").agg(
        F.count_if((F.col("place") <= top) & (F.col("ref_place") <= top)).alias("_i"), F.count_if((F.col("place") <= top) | (F.col("ref_place") <= top)).alias("_u"))
    rho = correlations(pairs, "value", "ref_value", by=["scenario_id"], minimum=2).select("scenario_id", "spearman")
    rows = cut(shared.join(shifts, "scenario_id").join(rho, "scenario_id").select(
        F.col("scenario_id").cast("double").alias("damping"), "spearman", (F.col("_i") / F.col("_u")).alias("top_jaccard"), "median_shift", "p95_shift", "max_shift"))
    worst = rows.agg(F.min("spearman").alias("r"), F.min("top_jaccard").alias("j")).select(
        F.when((F.col("r") >= 0.95) & (F.col("j") >= 0.75), "Stable").when((F.col("r") >= 0.85) & (F.col("j") >= 0.50), "Moderately Sensitive")
        .otherwise("Sensitive").alias("classification"))
    return rows.join(F.broadcast(worst))  # one row


def sampling_check(arcs: DataFrame, *, sample: int, reference: int | None, top: int = 100, seed: int = SEED) -> DataFrame:
    """Sampled betweenness against that of ``reference`` sources, or exact with None: rank correlation and top overlap."""
    a = betweenness(arcs, sample=sample, seed=seed).withColumnRenamed("betweenness", "a")
    b = betweenness(arcs, sample=reference, seed=seed + 1).withColumnRenamed("betweenness", "b")
    rows = cut(a.join(b, "id"))
    from meshflux.functions.inference import set_overlap

    rho = correlations(rows, "a", "b", minimum=2).select("n", "spearman")
    shared = set_overlap(rows.orderBy(F.desc("a"), "id").limit(top), rows.orderBy(F.desc("b"), "id").limit(top)).select("jaccard")
    return rho.join(F.broadcast(shared))  # two one-row tables


def hop_independence(arcs: DataFrame, responses: DataFrame, scores: DataFrame, target: str, *, top: int = 100) -> tuple[DataFrame, DataFrame]:
    """Whether responses merely follow centrality: correlations, and hop buckets of the strongest."""
    from meshflux.operators.traversal import hop_distances

    rows = cut(responses.join(scores, "id"))
    rho = None
    for name in ("pagerank", "degree", "importance"):
        part = correlations(rows, "delta_pct", name).select(F.lit(name).alias("against"), "spearman")
        rho = part if rho is None else rho.unionByName(part)
    origin = arcs.sparkSession.createDataFrame([(target,)], "source string")
    hops = hop_distances(arcs, origin, max_depth=3).select("id", "hop")
    best = rows.orderBy(F.desc(F.abs("delta_pct")), "id").limit(top).join(hops, "id", "left")
    bucket = F.when(F.col("hop").isNull(), "4+ or unreachable").otherwise(F.concat(F.col("hop").cast("string"), F.lit(" hop")))
    return rho, best.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("responses"))
