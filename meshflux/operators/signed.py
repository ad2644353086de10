"""Directed and signed arcs: orientation, bounded paths, convergence, routes.

Signed arcs carry ``status``: activation, inhibition, unsigned or conflicting,
with ``sign`` 1, -1 or 0. Uncertainty is kept: one unsigned or conflicting arc
makes the net sign of a path uncertain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshflux.functions.measures import direction, percent_change, strength_to_distance
from meshflux.operators.propagation import symmetric_arcs
from meshflux.operators.traversal import hop_distances, neighbourhood, shortest_distances, shortest_routes
from meshflux.session import Lineage, cut

FALLBACK = "undirected_fallback"
SUPPORTED = "directed_evidence"


def arc_status(stimulation: Column | str, inhibition: Column | str) -> Column:
    up, down = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False)) for c in (stimulation, inhibition))
    return F.when(up & down, "conflicting").when(up, "activation").when(down, "inhibition").otherwise("unsigned")


def sign_of(status: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == "activation", 1).when(s == "inhibition", -1).otherwise(0).cast("tinyint")


def orient(edges: DataFrame, evidence: DataFrame, *, force_symmetric: bool = False) -> DataFrame:
    """Directed arcs of an undirected graph, by directed evidence where it exists.

    A pair with evidence keeps only the supported directions, a pair without keeps
    both. Evidence never adds a pair. Signs are labels; weights do not change.
    ``evidence(src, dst, status, resources, refs)`` may repeat an arc.
    """
    lists = evidence.groupBy("src", "dst").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("resources")))).alias("resources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("refs")))).alias("refs"),
        F.array_sort(F.collect_set("status")).alias("signs"),
    )
    if force_symmetric:
        lists = lists.where("false")
    packed = lists.select("src", "dst", F.struct("resources", "refs", "signs").alias("proof"))
    forward = packed.withColumnRenamed("proof", "ahead")
    reverse = packed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("proof").alias("back"))
    pairs = edges.select("src", "dst", "weight").join(forward, ["src", "dst"], "left").join(reverse, ["src", "dst"], "left")
    none = F.col("ahead").isNull() & F.col("back").isNull()
    arc = lambda a, b, proof, wanted: F.when(
        wanted, F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(proof).alias("proof")))
    arcs = F.array_compact(F.array(
        arc("src", "dst", "ahead", none | F.col("ahead").isNotNull()), arc("dst", "src", "back", none | F.col("back").isNotNull())))
    out = pairs.select("weight", none.alias("is_fallback"), F.explode(arcs).alias("a"))
    empty = F.array().cast("array<string>")
    return out.select(
        "a.src", "a.dst", "weight", strength_to_distance("weight").alias("distance"),
        F.when(F.col("is_fallback"), FALLBACK).otherwise(SUPPORTED).alias("direction_source"),
        F.coalesce("a.proof.resources", empty).alias("resources"), F.coalesce("a.proof.refs", empty).alias("refs"),
        F.coalesce("a.proof.signs", empty).alias("signs"), "is_fallback")


def direction_coverage(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """How many pairs have one, two or no supported directions, and evidence outside the graph."""
    ways = evidence.select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (F.col("src") < F.col("dst")).alias("up")
    ).groupBy("src", "dst").agg(F.countDistinct("up").alias("ways"))
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    both = pairs.withColumn("_e", F.lit(True)).join(ways, ["src", "dst"], "full_outer")
    here = F.col("_e").isNotNull()
    return both.agg(
        F.count_if(here).alias("pairs"),
        F.count_if(here & (F.col("ways") == 1)).alias("single_direction"),
        F.count_if(here & (F.col("ways") == 2)).alias("both_directions"),
        F.count_if(here & F.col("ways").isNull()).alias("fallback"),
        F.count_if(~here).alias("evidence_outside"),
    ).withColumn("coverage", F.try_divide(
        (F.col("single_direction") + F.col("both_directions")).cast("double"), F.col("pairs").cast("double")))


def target_relations(arcs: DataFrame, targets: DataFrame) -> DataFrame:
    """Direct relation, support and signs between each node and the targets."""
    ids = targets.select(F.col("id").alias("target")).distinct()
    out = arcs.join(ids, F.col("src") == F.col("target")).select(F.col("dst").alias("id"), F.lit("out").alias("way"), "is_fallback", "signs")
    into = arcs.join(ids, F.col("dst") == F.col("target")).select(F.col("src").alias("id"), F.lit("in").alias("way"), "is_fallback", "signs")
    seen = out.unionByName(into)
    real = F.when(~F.col("is_fallback"), F.col("signs"))
    rows = seen.groupBy("id").agg(
        F.bool_or(F.col("way") == "out").alias("o"), F.bool_or(F.col("way") == "in").alias("i"),
        F.bool_or(~F.col("is_fallback")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(real)))).alias("sign_context"))
    return rows.select(
        "id",
        F.when(F.col("o") & F.col("i"), "bidirectional").when(F.col("o"), "target_to_entity").otherwise("entity_to_target").alias("relation"),
        F.when(F.col("s"), SUPPORTED).otherwise(FALLBACK).alias("support"),
        F.when(F.size("sign_context") > 0, F.array_join("sign_context", ";")).otherwise("not_available").alias("sign_context"))


def node_coverage(arcs: DataFrame) -> DataFrame:
    """Share of a node's arcs that rest on directed evidence."""
    ends = arcs.select(F.explode(F.array("src", "dst")).alias("id"), "is_fallback")
    return ends.groupBy("id").agg(F.avg((~F.col("is_fallback")).cast("double")).alias("direction_coverage"))


def directed_report(arcs: DataFrame, ranks_before: DataFrame, ranks_after: DataFrame, targets: DataFrame, *, max_hops: int = 8) -> DataFrame:
    """Directed response per entity with relation, hop distance, signs and coverage."""
    delta = F.col("perturbed") - F.col("baseline")
    rows = ranks_before.select("id", F.col("pagerank").alias("baseline")).join(
        ranks_after.select("id", F.col("pagerank").alias("perturbed")), "id")
    hops = hop_distances(arcs, targets.select(F.col("id").alias("source")), max_depth=max_hops).groupBy("id").agg(F.min("hop").alias("hops"))
    joined = (
        rows.join(targets.select("id"), "id", "left_anti")
        .join(target_relations(arcs, targets), "id", "left").join(hops, "id", "left").join(node_coverage(arcs), "id", "left"))
    return joined.select(
        "id", "baseline", "perturbed", delta.alias("delta"), percent_change("baseline", "perturbed", undefined=None).alias("delta_pct"),
        F.abs(delta).alias("abs_delta"), direction(delta).alias("direction"),
        F.coalesce("relation", F.lit("no_direct_relation")).alias("relation"), F.coalesce("support", F.lit("none")).alias("support"),
        "hops", F.coalesce("sign_context", F.lit("not_available")).alias("sign_context"),
        F.coalesce("direction_coverage", F.lit(0.0)).alias("direction_coverage"))


def bounded_paths(arcs: DataFrame, pairs: DataFrame, *, max_depth: int = 4, max_paths: int | None = None) -> DataFrame:
    """Simple paths between (source, target) pairs: ``source, target, path, statuses, hit_cap``.

    A partial path survives only if its end can still reach the target within the
    remaining depth. Only with ``max_paths`` a pair keeps its first paths, shorter
    ones first, then in lexicographic order, and is flagged if it has more.
    """
    if max_depth < 1 or (max_paths is not None and max_paths < 1):
        return _no_paths(arcs)
    lineage = Lineage(arcs.sparkSession)
    steps = lineage.cut(arcs.select("src", "dst", "status"))
    pairs = lineage.cut(pairs.select("source", "target").where("source <> target").distinct())
    left = _hops_left(lineage, steps, pairs, max_depth)
    live = pairs.select("source", "target", F.col("source").alias("at"), F.array("source").alias("path"), F.array().cast("array<string>").alias("statuses"))
    live = lineage.cut(live.join(left, ["target", "at"], "left_semi"))
    found = []
    for depth in range(1, max_depth + 1):
        grown = live.join(steps.withColumnRenamed("src", "at"), "at").where(~F.array_contains("path", F.col("dst")))
        grown = grown.select(
            "source", "target", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"),
            F.concat("statuses", F.array("status")).alias("statuses"))
        reachable = grown.join(left, ["target", "at"]).where(F.col("hop") <= max_depth - depth).drop("hop")
        reachable = lineage.cut(reachable)
        found.append(reachable.where("at = target"))
        live = reachable.where("at <> target")
        if live.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    if max_paths is None:
        return every.select("source", "target", "path", "statuses", F.lit(False).alias("hit_cap"))
    order = Window.partitionBy("source", "target").orderBy(F.size("path"), "path")
    counted = every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_paths + 1)
    capped = counted.groupBy("source", "target").agg((F.max("place") > max_paths).alias("hit_cap"))
    return counted.where(F.col("place") <= max_paths).join(capped, ["source", "target"]).select(
        "source", "target", "path", "statuses", "hit_cap")


def _hops_left(lineage: Lineage, steps: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """``target, at, hop``: least hops to each target from the nodes on some way of at most ``max_depth`` from a source to it.

    A node that no source reaches soon enough is on no such way, so the search
    back from a target does not enter it; the hops of the others stay exact.
    """
    near = neighbourhood(steps, pairs.select(F.col("source").alias("id")).distinct(), hops=max_depth).withColumnRenamed("hop", "start")
    links = lineage.cut(steps.select(F.col("dst").alias("at"), F.col("src").alias("id")).distinct().join(near, "id"))
    frontier = lineage.cut(pairs.select("target", F.col("target").alias("at"), F.lit(0).alias("hop")).distinct())
    found = frontier
    for hop in range(1, max_depth + 1):
        grown = frontier.select("target", "at").join(links.where(F.col("start") <= max_depth - hop), "at").select("target", F.col("id").alias("at")).distinct()
        frontier = lineage.cut(grown.join(found.select("target", "at"), ["target", "at"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def _no_paths(arcs: DataFrame) -> DataFrame:
    return arcs.sparkSession.createDataFrame([], "source string, target string, path array<string>, statuses array<string>, hit_cap boolean")


def path_category(statuses: Column | str) -> Column:
    """activation or inhibition by the product of signs; conflicting means uncertain, then unsigned."""
    s = F.col(statuses) if isinstance(statuses, str) else statuses
    negatives = F.size(F.filter(s, lambda x: x == "inhibition"))
    return (
        F.when(F.array_contains(s, "conflicting"), "uncertain").when(F.array_contains(s, "unsigned"), "unsigned")
        .when(negatives % 2 == 0, "activation").otherwise("inhibition"))


def path_net_sign(statuses: Column | str) -> Column:
    """Net sign of one path; unsigned and conflicting arcs both make it uncertain."""
    category = path_category(statuses)
    return F.when(category == "unsigned", "uncertain").otherwise(category)


def summarize_paths(paths: DataFrame) -> DataFrame:
    """Counts by sign, shortest example and net sign per (source, target)."""
    rated = paths.withColumn("category", path_category("statuses"))
    count = lambda name: F.count_if(F.col("category") == name)
    rows = rated.groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("path_count"), count("activation").alias("positive_paths"), count("inhibition").alias("negative_paths"),
        count("unsigned").alias("unsigned_paths"), count("uncertain").alias("uncertain_paths"),
        F.min(F.struct(F.size("path").alias("n"), "path")).alias("best"), F.bool_or("hit_cap").alias("hit_cap"))
    mixed = (F.col("uncertain_paths") > 0) | (F.col("unsigned_paths") > 0) | ((F.col("positive_paths") > 0) & (F.col("negative_paths") > 0))
    net = F.when(mixed, "uncertain").when(F.col("positive_paths") > 0, "activation").when(F.col("negative_paths") > 0, "inhibition").otherwise("uncertain")
    return rows.select(
        "source", "target", (F.col("best.n") - 1).alias("shortest"), F.col("best.path").alias("example"), "path_count",
        "positive_paths", "negative_paths", "unsigned_paths", "uncertain_paths", net.alias("net_sign"), "hit_cap")


def reachability(arcs: DataFrame, pairs: DataFrame, *, max_depth: int = 4, core: DataFrame | None = None) -> DataFrame:
    """Relation of each (source, target) pair within ``max_depth`` hops.

    ``core(id)`` lists nodes known outside the signalling layer; a downstream pair
    with an end outside it is ``signaling-only relationship``.
    """
    sources = pairs.select("source").distinct()
    lineage = Lineage(arcs.sparkSession)
    steps = lineage.cut(arcs.select("src", "dst").distinct())
    down = hop_distances(steps, sources, max_depth=max_depth).where("hop > 0").select("source", F.col("id").alias("target"), F.col("hop").alias("down"))
    up = hop_distances(steps, sources, max_depth=max_depth, reverse=True).where("hop > 0").select("source", F.col("id").alias("target"), F.col("hop").alias("up"))
    nodes = steps.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("known", F.lit(True))
    rows = pairs.select("source", "target").distinct().join(down, ["source", "target"], "left").join(up, ["source", "target"], "left")
    for end in ("source", "target"):
        rows = rows.join(nodes.select(F.col("id").alias(end), F.col("known").alias(f"_{end}")), end, "left")
    outside = F.lit(False)
    if core is not None:
        inside = core.select("id").distinct().withColumn("_c", F.lit(True))
        for end in ("source", "target"):
            rows = rows.join(inside.select(F.col("id").alias(end), F.col("_c").alias(f"_core_{end}")), end, "left")
        outside = F.col("_core_source").isNull() | F.col("_core_target").isNull()
    relation = (
        F.when(F.col("_source").isNull() | F.col("_target").isNull(), "unresolved")
        .when(F.col("down").isNotNull() & F.col("up").isNotNull(), "bidirectionally reachable")
        .when(F.col("down").isNotNull() & outside, "signaling-only relationship")
        .when(F.col("down") == 1, "direct downstream").when(F.col("down").isNotNull(), "indirect downstream")
        .when(F.col("up").isNotNull(), "upstream").otherwise("no directed path"))
    return rows.select("source", "target", relation.alias("relation"), "down", "up")


def convergence(arcs: DataFrame, targets: DataFrame, *, max_depth: int = 4, limit: int | None = None, with_signs: bool = True) -> DataFrame:
    """Nodes reached from at least two targets, nearest first."""
    sources = targets.select(F.col("id").alias("source")).distinct()
    reached = cut(hop_distances(arcs, sources, max_depth=max_depth).where("hop > 0"))
    met = reached.groupBy("id").agg(
        F.count(F.lit(1)).alias("targets"), F.sum("hop").alias("total_distance"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "hop")))).alias("distances")).where("targets >= 2")
    best = cut(met if limit is None else met.orderBy("total_distance", "id").limit(limit))
    if not with_signs:
        return best
    pairs = best.select(F.col("id").alias("target"), F.explode(F.map_keys("distances")).alias("source"))
    signs = summarize_paths(bounded_paths(arcs, pairs, max_depth=max_depth)).groupBy(F.col("target").alias("id")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "net_sign")))).alias("signed_relations"))
    return best.join(signs, "id", "left")


def _shared_descendants(lineage: Lineage, steps: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """The (source, target) pairs that both reach some third node within ``max_depth`` hops.

    What a source reaches is followed back, all of it at once: a node holds the
    least and the greatest of the reached nodes it can come to, as two are enough
    to know one that is not the node itself. So a round is one row a node, source
    and arc, however many targets there are.
    """
    links = lineage.cut(steps.select("src", F.col("dst").alias("at")).distinct())
    reached = hop_distances(steps, pairs.select("source").distinct(), max_depth=max_depth).where("hop > 0 AND id <> source")
    first = lineage.cut(reached.select("source", F.col("id").alias("at"), F.col("id").alias("lo"), F.col("id").alias("hi")))
    state = first
    for _ in range(max_depth):
        back = state.join(links, "at").select("source", F.col("src").alias("at"), "lo", "hi")
        fresh = lineage.cut(first.unionByName(back).groupBy("source", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        if state is not first:
            lineage.drop(state)
        state = fresh
    others = state.where("lo <> at OR hi <> at").select("source", F.col("at").alias("target"))
    return lineage.cut(pairs.select("source", "target").distinct().join(others, ["source", "target"], "left_semi"))


def annotate_responses(
    arcs: DataFrame, responses: DataFrame, targets: DataFrame, *, max_depth: int = 4, supported: DataFrame | None = None,
    core: DataFrame | None = None,
) -> DataFrame:
    """Directed context of every (target, response) pair; responses are never re-ranked."""
    lineage = Lineage(arcs.sparkSession)
    steps = lineage.cut(arcs.select("src", "dst", "status"))
    # The targets of one call are a short list; each response row meets all of them.
    names = [row["id"] for row in targets.select("id").distinct().orderBy("id").collect()]
    every = F.explode(F.array(*[F.lit(name) for name in names])).alias("source")
    pairs = lineage.cut(responses.select(F.col("id").alias("target")).distinct().select(every, "target").where("source <> target"))
    relation = lineage.cut(reachability(steps, pairs, max_depth=max_depth, core=core))
    linked = relation.where("down IS NOT NULL").select("source", "target")
    upward = relation.where("down IS NULL AND up IS NOT NULL").select(F.col("target").alias("source"), F.col("source").alias("target"))
    ahead = summarize_paths(bounded_paths(steps, linked, max_depth=max_depth))
    behind = summarize_paths(bounded_paths(steps, upward, max_depth=max_depth))
    behind = behind.select(F.col("target").alias("source"), F.col("source").alias("target"), *behind.columns[2:])
    paths = ahead.unionByName(behind)
    meets = _shared_descendants(lineage, steps, pairs, max_depth).withColumn("alternative_route", F.lit(True))
    rows = relation.join(paths, ["source", "target"], "left").join(meets, ["source", "target"], "left")
    support = F.lit("tissue support unavailable")
    if supported is not None:
        ids = supported.select("id").distinct().withColumn("_s", F.lit(True))
        for end in ("source", "target"):
            rows = rows.join(ids.select(F.col("id").alias(end), F.col("_s").alias(f"_{end}")), end, "left")
        s, d = F.col("_source").isNotNull(), F.col("_target").isNotNull()
        support = F.when(s & d, "both supported").when(s, "source-only").when(d, "target-only").otherwise("neither supported")
    return rows.select(
        "source", "target", "relation", "shortest", "example", F.coalesce("path_count", F.lit(0)).alias("path_count"),
        F.coalesce("net_sign", F.lit("no_path")).alias("net_sign"), F.coalesce("alternative_route", F.lit(False)).alias("alternative_route"),
        support.alias("context_support"))


# --- propagation trace -------------------------------------------------------

def pair_evidence(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Directed evidence of undirected lookups; ``reverse`` when only the backward record exists.

    ``evidence(src, dst, status)``; result per pair: ``statuses, effect``.
    """
    ahead = evidence.select("src", "dst", "status", F.lit(0).alias("rank"))
    back = evidence.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "status", F.lit(1).alias("rank"))
    seen = pairs.select("src", "dst").distinct().join(ahead.unionByName(back), ["src", "dst"])
    rows = seen.groupBy("src", "dst").agg(F.array_sort(F.collect_set("status")).alias("statuses"), F.min(F.struct("rank", "status")).alias("best"))
    return rows.select("src", "dst", F.array_join("statuses", ";").alias("statuses"),
                       F.when(F.col("best.rank") == 0, F.col("best.status")).otherwise("reverse").alias("effect"),
                       (F.col("best.rank") == 0).alias("is_forward"))


def trace_candidates(report: DataFrame, target: str, *, max_nodes: int) -> DataFrame:
    """Target, significant, strong and bottleneck rows, filled up by the largest |delta|."""
    protected = (F.col("id") == target) | F.col("is_significant") | F.col("is_strong") | F.col("is_bottleneck")
    rows = report.withColumn("protected", F.coalesce(protected, F.lit(False)))
    kept = rows.where("protected").select("id")
    room = max(0, max_nodes - kept.distinct().count())
    rest = rows.where("NOT protected").orderBy(F.desc_nulls_last("abs_delta"), "id").limit(room).select("id")
    return kept.unionByName(rest).distinct()


def propagation_trace(
    edges: DataFrame, report: DataFrame, target: str, evidence: DataFrame, *, max_nodes: int, max_routes: int, max_hops: int = 3
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trace nodes, routes and route edges around a target.

    ``report(id, delta, abs_delta, is_significant, is_strong, is_bottleneck)``. The
    evidence type of a route looks at the edges of that route only.
    """
    spark = edges.sparkSession
    arcs = cut(symmetric_arcs(edges, "distance"))
    origin = spark.createDataFrame([(target,)], "source string")
    near = arcs.where(F.col("src") == target).select(F.col("dst").alias("id"))
    wanted = trace_candidates(report, target, max_nodes=max_nodes).unionByName(near).unionByName(
        origin.select(F.col("source").alias("id"))).distinct()
    layers = hop_distances(arcs, origin, max_depth=max_hops).select("id", "hop")
    touching = pair_evidence(near.select(F.lit(target).alias("src"), F.col("id").alias("dst")), evidence).select(F.col("dst").alias("id"), F.lit(True).alias("directed"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    nodes = layers.join(wanted, "id", "left_semi").join(report, "id", "left").join(touching, "id", "left").select(
        "id", F.col("hop").alias("layer"), "delta", flag("is_significant"),
        F.coalesce(F.col("is_strong") | F.col("is_bottleneck"), F.lit(False)).alias("is_critical"), flag("directed"))
    nodes = cut(nodes.orderBy("layer", F.desc("is_significant"), F.desc("is_critical"), F.desc_nulls_last("delta"), "id").limit(max_nodes))
    ends = nodes.where("layer > 0").orderBy("layer", F.desc("is_significant"), F.desc("is_critical"), F.desc_nulls_last("delta"), "id").limit(max_routes)
    distances = cut(shortest_distances(arcs, origin))
    routes = cut(shortest_routes(arcs, distances, ends.select(F.lit(target).alias("source"), "id")))
    steps = routes.select("id", F.posexplode(F.arrays_zip(
        F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path") - 1).alias("dst"))).alias("place", "step")
    ).select("id", "place", "step.src", "step.dst")
    steps = cut(steps.join(pair_evidence(steps, evidence), ["src", "dst"], "left").select(
        "id", "place", "src", "dst", F.coalesce("statuses", F.lit("structural_only")).alias("statuses"),
        F.col("statuses").isNotNull().alias("has_evidence"), F.coalesce("is_forward", F.lit(False)).alias("is_forward")))
    per_route = steps.groupBy("id").agg(
        F.count_if("has_evidence").alias("directed_edges"), F.bool_or(F.col("statuses").contains("conflicting")).alias("conflict"))
    kind = (
        F.when(F.col("directed_edges") == 0, "structural route").when(F.col("conflict"), "mixed evidence route (conflicting)")
        .otherwise("mixed evidence route"))
    routes = routes.join(per_route, "id").select("id", F.array_join("path", " -> ").alias("route"), (F.size("path") - 1).alias("length"), kind.alias("route_type"), "directed_edges")
    return nodes, routes, steps.select("src", "dst", "statuses", "has_evidence", "is_forward").distinct()


def filter_trace(nodes: DataFrame, *, layer_limit: int = 3, critical_only=False, significant_only=False, directed_only=False) -> DataFrame:
    out = nodes.where(F.col("layer") <= layer_limit)
    for wanted, column in ((critical_only, "is_critical"), (significant_only, "is_significant"), (directed_only, "directed")):
        if wanted:
            out = out.where(F.col(column))
    return out


def strategy_audit(
    arcs: DataFrame, target: str, *, factor: float, damping: float = 0.85, tolerance: float = 1e-9, strategies: Sequence[str] = ("incident", "incoming", "outgoing", "removal")
) -> DataFrame:
    """L1 shift, median rank shift, downstream and upstream change of four ways to weaken one node."""
    from meshflux.functions.ordering import quantiles, row_numbers
    from meshflux.operators.propagation import Scenario, pagerank
    from meshflux.plans.scenarios import compare, overrides_for

    spark = arcs.sparkSession
    arcs = cut(arcs.select("src", "dst", "weight"))
    own = None
    for name in strategies:
        table = spark.createDataFrame([(name, target, 0.0 if name == "removal" else float(factor))], "scenario_id string, id string, factor double")
        part = overrides_for(arcs, table, mode=name if name in ("incoming", "outgoing") else "incident")
        own = part if own is None else own.unionByName(part)
    ranks = pagerank(arcs, scenarios=[Scenario("base", damping)] + [Scenario(n, damping) for n in strategies],
                     overrides=own, symmetric=False, tolerance=tolerance)
    rows = cut(compare(cut(ranks)).where(F.col("id") != target))
    placed = row_numbers(rows, [F.desc(F.round("baseline", 10)), F.asc("id")], by=["scenario_id"], name="place_before")
    placed = row_numbers(placed, [F.desc(F.round("perturbed", 10)), F.asc("id")], by=["scenario_id"], name="place_after")
    shifts = quantiles(placed.withColumn("shift", F.abs(F.col("place_after") - F.col("place_before")).cast("double")), "shift", {"median_rank_shift": 0.5}, by=["scenario_id"]).drop("n")
    origin = spark.createDataFrame([(target,)], "source string")
    down = hop_distances(arcs, origin, max_depth=3).where("hop > 0").select("id", F.lit(True).alias("down"))
    up = hop_distances(arcs, origin, max_depth=3, reverse=True).where("hop > 0").select("id", F.lit(True).alias("up"))
    marked = rows.join(down, "id", "left").join(up, "id", "left")
    return marked.groupBy("scenario_id").agg(
        F.sum("abs_delta").alias("l1_shift"), F.sum(F.when(F.col("down"), F.col("delta"))).alias("downstream_change"),
        F.sum(F.when(F.col("up"), F.col("delta"))).alias("upstream_change")).join(shifts, "scenario_id")
