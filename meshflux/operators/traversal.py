"""Shortest distances, hops, routes, neighbourhoods, components, efficiency.

Shortest distances run on blocks of arcs (``searches``). Hops up to a depth, and
searches from very many sources, hold (key, source, node) state; every round is
written to the shared folder. Arcs stay an ordinary table there, so that the
adaptive planner can broadcast a small frontier, or split the arcs of a hot node
when the frontier is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshflux.operators.searches import EPSILON, searches, whole
from meshflux.session import Lineage

#: Rounds after which the tables of improved distances are merged.
PARTS = 12


def sample_ids(vertices: DataFrame, size: int | None, seed: int = 42) -> DataFrame:
    """All ids, or ``size`` of them in an order fixed by a seeded hash."""
    ids = vertices.select("id").distinct()
    if size is None:
        return ids
    return ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(size)


def vertices_of(edges: DataFrame, *by: str) -> DataFrame:
    return edges.select(*by, F.explode(F.array("src", "dst")).alias("id")).distinct()


def shortest_distances(arcs: DataFrame, sources: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Least total ``distance`` from each source: ``by.., source, id, dist``.

    Runs until no distance improves: on blocks of arcs, or by joins where the
    vectors of all sources would hold far more than the searches can reach.
    """
    by = list(by)
    keys = [*by, "source"]
    lineage = Lineage(arcs.sparkSession)
    sources = lineage.cut(sources.select(*keys).distinct())
    usable = whole(usable_arcs(arcs, by), *by, "src")
    usable = usable if hasattr(arcs, "_cut_path") else lineage.cut(usable)
    layout = searches(usable, whole(sources, *keys), by)
    if layout is None:
        return _relax(usable, sources, by, None)
    try:
        found = None
        for first, last in layout.turns():
            part = layout.rows(layout.distances(first, last), float("inf"))
            found = part if found is None else found.unionByName(part)
    finally:
        layout.close()
    named = found.join(layout.sources.select(*keys, "slot"), [*by, "slot"]).select(*keys, "id", F.col("value").alias("dist"))
    # A source without a name or key reaches itself alone.
    missing = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1
    return lineage.cut(named.unionByName(sources.where(missing).select(*keys, F.col("source").alias("id"), F.lit(0.0).alias("dist"))))


def usable_arcs(arcs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Arcs with a length."""
    usable = F.col("distance").isNotNull() & ~F.isnan("distance") & (F.col("distance") < F.lit(float("inf")))
    return arcs.where(usable).select(*by, "src", "dst", F.col("distance").cast("double").alias("distance"))


def _relax(arcs: DataFrame, sources: DataFrame, by: Sequence[str], rounds: int | None) -> DataFrame:
    """Distances by frontiers: a round extends and writes only what improved in the one before.

    Known distances are the rows of all rounds so far, looked up for the ends
    just reached; the least per end is taken when the loop is done.
    """
    by = list(by)
    keys = [*by, "source", "id"]
    lineage = Lineage(arcs.sparkSession)
    arcs = lineage.cut(usable_arcs(arcs, by))
    frontier = lineage.cut(sources.select(*by, "source", F.col("source").alias("id"), F.lit(0.0).alias("dist")).distinct())
    known, done = frontier, 0
    while rounds is None or done < rounds:
        ends = frontier.select(*by, "source", F.col("id").alias("src"), F.col("dist").alias("base"))
        reached = ends.join(arcs, [*by, "src"]).select(*by, "source", F.col("dst").alias("id"), (F.col("base") + F.col("distance")).alias("dist"))
        best = reached.groupBy(*keys).agg(F.min("dist").alias("dist"))
        better = known.select(*keys, F.col("dist").alias("old"))
        # A row that some round has reached as cheaply is no news.
        frontier = lineage.cut(best.join(better, [best[k] == better[k] for k in keys] + [better["old"] <= best["dist"]], "left_anti"))
        done += 1
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if done % PARTS == 0:
            known = lineage.cut(known.groupBy(*keys).agg(F.min("dist").alias("dist")))
            lineage.release(arcs, frontier, known)
    found = lineage.cut(known.groupBy(*keys).agg(F.min("dist").alias("dist")))
    lineage.release(found)
    return found


def hop_distances(
    arcs: DataFrame, sources: DataFrame, *, max_depth: int, reverse: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """Hops from each source up to ``max_depth``: ``by.., source, id, hop`` (source itself at 0)."""
    if max_depth < 0:
        raise ValueError("max_depth cannot be negative")
    by = list(by)
    ends = [F.col("dst").alias("src"), F.col("src").alias("dst")] if reverse else ["src", "dst"]
    steps = arcs.select(*by, *ends).distinct().withColumn("distance", F.lit(1.0))
    if max_depth == 0:
        return sources.select(*by, "source", F.col("source").alias("id"), F.lit(0).alias("hop"))
    found = _relax(steps, sources, by, max_depth)
    return found.select(*by, "source", "id", F.col("dist").cast("int").alias("hop"))


def neighbourhood(arcs: DataFrame, seeds: DataFrame, *, hops: int, limit: int | None = None) -> DataFrame:
    """Ids within ``hops`` of any seed with their least hop; with ``limit`` the nearest ids first."""
    marked = arcs.select("src", "dst").unionByName(
        seeds.select(F.lit(" ").alias("src"), F.col("id").alias("dst")).distinct()
    )
    origin = arcs.sparkSession.createDataFrame([(" ",)], "source string")
    found = hop_distances(marked, origin, max_depth=hops + 1).where("id <> ' '")
    out = found.select("id", (F.col("hop") - 1).alias("hop"))
    return out if limit is None else out.orderBy("hop", "id").limit(limit)


def shortest_routes(arcs: DataFrame, distances: DataFrame, endpoints: DataFrame) -> DataFrame:
    """One shortest route per (source, endpoint): ``source, id, dist, path``.

    Walks back from the endpoints only; among equal predecessors the least id wins.
    """
    lineage = Lineage(arcs.sparkSession)
    backward = arcs.select(F.col("dst").alias("at"), F.col("src").alias("prev"), "distance")
    known = distances.select("source", "id", "dist")
    state = lineage.cut(
        known.join(endpoints.select("source", "id").distinct(), ["source", "id"])
        .select("source", "id", "dist", F.col("id").alias("at"), F.col("dist").alias("left"), F.array("id").alias("path"))
    )
    # Every step brings the walk strictly nearer to its source, so it ends.
    while True:
        open_rows = state.where(F.col("at") != F.col("source"))
        if open_rows.isEmpty():
            break
        before = known.select("source", F.col("id").alias("prev"), F.col("dist").alias("prev_dist"))
        tight = F.abs(F.col("prev_dist") + F.col("distance") - F.col("left")) <= F.lit(EPSILON) * F.greatest(F.lit(1.0), F.col("left"))
        steps = open_rows.join(backward, "at").join(before, ["source", "prev"]).where(tight & (F.col("prev_dist") < F.col("left")))
        chosen = steps.groupBy("source", "id").agg(
            F.min(F.struct("prev", "prev_dist")).alias("step"), F.first("dist").alias("dist"), F.first("path").alias("path")
        )
        moved = chosen.select(
            "source", "id", "dist", F.col("step.prev").alias("at"), F.col("step.prev_dist").alias("left"),
            F.concat(F.array("step.prev"), F.col("path")).alias("path"),
        )
        done = state.where(F.col("at") == F.col("source"))
        fresh = lineage.cut(done.unionByName(moved))
        lineage.drop(state)
        state = fresh
    return state.select("source", "id", "dist", "path")


def induced_subgraph(edges: DataFrame, members: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Edges with both ends among the members (per key, when keyed)."""
    by = list(by)
    ids = members.select(*by, "id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), [*by, "src"], "left_semi").join(
        ids.withColumnRenamed("id", "dst"), [*by, "dst"], "left_semi"
    ).select(*edges.columns)


def focus_subgraph(edges: DataFrame, core: DataFrame, scores: DataFrame, *, max_nodes: int, hops: int = 1) -> DataFrame:
    """Core ids plus their best-scored surroundings, up to ``max_nodes``: ``id, is_core``."""
    from meshflux.operators.propagation import symmetric_arcs

    around = neighbourhood(symmetric_arcs(edges), core, hops=hops)
    rated = around.join(scores.select("id", "importance"), "id", "left").withColumn("is_core", F.col("hop") == 0)
    order = [F.desc("is_core"), F.col("importance").desc_nulls_last(), F.asc("id")]
    return rated.orderBy(*order).limit(max_nodes).select("id", "is_core")


def reconnecting_bridges(edges: DataFrame, core: DataFrame, *, top: int = 3) -> DataFrame:
    """For core ids without a core neighbour: their strongest edges into the graph.

    Bridge edges come first, then heavier ones; ``top`` edges per isolated id.
    """
    from meshflux.operators.propagation import symmetric_arcs

    ids = core.select("id").distinct()
    arcs = symmetric_arcs(edges, "weight", "is_bridge").join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    inside = arcs.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    alone = ids.join(inside.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    out = arcs.join(alone.withColumnRenamed("id", "src"), "src", "left_semi")
    return _top_arcs(out, top)


def _top_arcs(arcs: DataFrame, top: int) -> DataFrame:
    """The first ``top`` arcs per src; Spark prunes each partition before the shuffle."""
    order = Window.partitionBy("src").orderBy(F.desc("is_bridge"), F.desc("weight"), "dst")
    return arcs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def components(edges: DataFrame, *, vertices: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Least reachable id per node: ``by.., id, component``, by alternating star contraction.

    Each round halves path lengths, so the number of rounds is logarithmic.
    """
    by = list(by)
    lineage = Lineage(edges.sparkSession)
    nodes = vertices_of(edges, *by)
    if vertices is not None:
        nodes = nodes.unionByName(vertices.select(*by, "id")).distinct()
    nodes = lineage.cut(nodes)
    links = lineage.cut(edges.where("src <> dst").select(
        *by, F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = _mark(links, by)
    while True:
        both = links.select(*by, F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l"))
        both = both.select(*by, "l.a", "l.b")
        low = both.groupBy(*by, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, [*by, "a"]).where("b > a").select(*by, F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        floor = large.groupBy(*by, "a").agg(F.min("b").alias("m"))
        small = large.join(floor, [*by, "a"]).select(
            *by, F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("l"))
        fresh = lineage.cut(small.select(*by, "l.a", "l.b").where("a <> b").distinct())
        after = _mark(fresh, by)
        lineage.drop(links)
        links = fresh
        if after == mark:
            break
        mark = after
    roots = links.select(*by, F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.join(roots, [*by, "id"], "left").withColumn("component", F.coalesce("component", "id"))


def _mark(links: DataFrame, by: Sequence[str]):
    """Count and order-free digest of a link table: equal marks mean no change."""
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*by, "a", "b"))).first()


def largest_component(membership: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Size of the largest component and its share of the nodes, per key."""
    by = list(by)
    sizes = membership.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(*by).agg(
        F.sum("size").alias("nodes"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("components")
    ).withColumn("ratio", F.col("largest") / F.col("nodes"))


def global_efficiency(
    arcs: DataFrame, *, sample: int | None = None, seed: int = 42, vertices: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Mean inverse distance from the (sampled) sources to all other nodes, per key."""
    by = list(by)
    nodes = vertices_of(arcs, *by) if vertices is None else vertices.select(*by, "id").distinct()
    if sample is None:
        sources = nodes.withColumnRenamed("id", "source")
    else:
        order = Window.partitionBy(*by).orderBy(F.xxhash64("id", F.lit(seed)), "id") if by else None
        picked = (
            nodes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample).drop("_r")
            if by else sample_ids(nodes, sample, seed)
        )
        sources = picked.withColumnRenamed("id", "source")
    lineage = Lineage(arcs.sparkSession)
    sources = lineage.cut(sources)
    found = shortest_distances(arcs, sources, by=by)
    return efficiency_of(found, sources, nodes, by=by)


def efficiency_of(distances: DataFrame, sources: DataFrame, nodes: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    inverse = distances.where("dist > 0").groupBy(*by).agg(F.sum(F.lit(1.0) / F.col("dist")).alias("inverse"))
    k = sources.groupBy(*by).agg(F.count(F.lit(1)).alias("sources"))
    n = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"))
    if by:
        joined = n.join(k, by, "left").join(inverse, by, "left")
    else:
        joined = n.join(k).join(inverse)  # three one-row tables
    pairs = F.col("sources") * (F.col("nodes") - 1)
    return joined.select(
        *by, "nodes", F.coalesce("sources", F.lit(0)).alias("sources"),
        F.when(pairs > 0, F.coalesce("inverse", F.lit(0.0)) / pairs).otherwise(0.0).alias("efficiency"),
    )


def pair_efficiency(arcs: DataFrame, members: DataFrame) -> DataFrame:
    """Efficiency among listed ids only: per id, the mean over the ids it reaches."""
    ids = members.select("id").distinct()
    found = shortest_distances(arcs, ids.withColumnRenamed("id", "source")).join(ids, "id", "left_semi").where("dist > 0")
    per = found.groupBy(F.col("source").alias("id")).agg(
        F.avg(F.lit(1.0) / F.col("dist")).alias("node_efficiency"), F.sum(F.lit(1.0) / F.col("dist")).alias("inverse")
    )
    return ids.join(per, "id", "left").fillna(0.0, ["node_efficiency", "inverse"])


def local_efficiency(arcs: DataFrame, *, sample: int | None = None, seed: int = 42, egos: DataFrame | None = None) -> DataFrame:
    """Efficiency of each (sampled, or listed) node's open neighbourhood: ``id, neighbours, efficiency``."""
    lineage = Lineage(arcs.sparkSession)
    arcs = lineage.cut(arcs.select("src", "dst", "distance"))
    egos = lineage.cut(sample_ids(vertices_of(arcs), sample, seed) if egos is None else egos.select("id").distinct())
    around = lineage.cut(arcs.join(egos.withColumnRenamed("id", "src"), "src", "left_semi").select(
        F.col("src").alias("ego"), F.col("dst").alias("id")).where("ego <> id").distinct())
    return _ego_efficiency(lineage, arcs, egos, around)


def _ego_efficiency(lineage, arcs, egos, around):
    inner = arcs.join(around.withColumnRenamed("id", "src"), "src").join(
        around.withColumnRenamed("id", "dst"), ["ego", "dst"], "left_semi").select("ego", "src", "dst", "distance")
    rated = efficiency_of(
        shortest_distances(inner, around.withColumnRenamed("id", "source"), by=["ego"]), around, around, by=["ego"]
    )
    return egos.join(rated.withColumnRenamed("ego", "id"), "id", "left").select(
        "id", F.coalesce("nodes", F.lit(0)).alias("neighbours"), F.coalesce("efficiency", F.lit(0.0)).alias("efficiency")
    )


def target_efficiency(arcs: DataFrame, targets: DataFrame, *, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Efficiency of the subgraph of the targets and all their neighbours."""
    ids = targets.select("id").distinct()
    near = arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    members = near.unionByName(ids.join(vertices_of(arcs), "id", "left_semi")).distinct()
    return global_efficiency(induced_subgraph(arcs, members), sample=sample, seed=seed, vertices=members)
