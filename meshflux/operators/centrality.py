"""Weighted betweenness, congestion and bottleneck detection.

Shortest-path counting runs over the shortest-path arcs of each source, in blocks
(``searches``), some sources a turn, or, where keys are of unlike size, as a chain of joins. Path counts are summed by path length, and dependencies likewise,
so the number of rounds is the largest number of arcs on a shortest path; no
ordering of the nodes is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshflux.functions.ordering import quantiles
from meshflux.operators.searches import EPSILON, searches, whole
from meshflux.operators.traversal import sample_ids, shortest_distances, usable_arcs, vertices_of
from meshflux.session import Lineage
from meshflux.settings import BETWEENNESS_PERCENTILE, EXTERNAL_RATIO_MIN


def betweenness(
    arcs: DataFrame,
    *,
    directed: bool = False,
    sample: int | None = None,
    seed: int = 42,
    sources: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Betweenness per node: ``by.., id, betweenness``, scaled to all sources when sampled."""
    by = list(by)
    lineage = Lineage(arcs.sparkSession)
    arcs = lineage.cut(arcs.select(*by, "src", "dst", F.col("distance").cast("double").alias("distance")))
    nodes = lineage.cut(vertices_of(arcs, *by))
    if sources is None:
        picked = sample_ids(nodes, sample, seed) if sample is not None else nodes.select("id").distinct()
        sources = nodes.join(picked, "id", "left_semi")
    sources = lineage.cut(sources.select(*by, F.col("id").alias("source")).distinct())
    totals = _dependencies(lineage, arcs, sources, by)
    sizes = _scale(nodes, sources, by)
    joined = nodes.join(totals, [*by, "id"], "left")
    joined = joined.join(sizes, by) if by else joined.join(F.broadcast(sizes))  # one row without keys
    factor = F.col("scale") * F.lit(1.0 if directed else 0.5)
    return joined.select(*by, "id", (F.coalesce("value", F.lit(0.0)) * factor).alias("betweenness"))


def _dependencies(lineage, arcs, sources, by):
    """Shares of shortest paths through each node, over all sources but itself: ``by.., id, value``."""
    layout = searches(whole(usable_arcs(arcs, by), *by, "src", "dst"), whole(sources, *by, "source"), by, turns=None)
    if layout is None:
        return _joined_dependencies(lineage, arcs, sources, by)
    try:
        parts = None
        for first, last in layout.turns():
            part = layout.dependencies(first, last)
            parts = part if parts is None else layout.added(parts, part)
    finally:
        layout.close()
    return layout.rows(parts, 0.0).groupBy(*by, "id").agg(F.sum("value").alias("value"))


def _joined_dependencies(lineage, arcs, sources, by):
    """The same by joins, for keys of unlike size."""
    distances = lineage.cut(shortest_distances(arcs, sources, by=by))
    at_source = distances.select(*by, "source", F.col("id").alias("src"), F.col("dist").alias("du"))
    at_target = distances.select(*by, "source", F.col("id").alias("dst"), F.col("dist").alias("dv"))
    tight = F.abs(F.col("du") + F.col("distance") - F.col("dv")) <= F.lit(EPSILON) * F.greatest(F.lit(1.0), F.col("dv"))
    steps = lineage.cut(
        at_source.join(arcs, [*by, "src"]).join(at_target, [*by, "source", "dst"])
        .where(tight & (F.col("dv") > F.col("du"))).select(*by, "source", "src", "dst")
    )
    start = sources.select(*by, "source", F.col("source").alias("id"), F.lit(1.0).alias("value"))
    paths = _accumulate(lineage, start, steps.withColumn("share", F.lit(1.0)), "src", "dst", by, keep_first=True)
    counts = lineage.cut(paths)
    shares = lineage.cut(
        steps.join(counts.select(*by, "source", F.col("id").alias("src"), F.col("value").alias("su")), [*by, "source", "src"])
        .join(counts.select(*by, "source", F.col("id").alias("dst"), F.col("value").alias("sv")), [*by, "source", "dst"])
        .select(*by, "source", "src", "dst", (F.col("su") / F.col("sv")).alias("share"))
    )
    ones = counts.select(*by, "source", "id", F.lit(1.0).alias("value"))
    depends = _accumulate(lineage, ones, shares, "dst", "src", by, keep_first=False)
    return depends.where("id <> source").groupBy(*by, "id").agg(F.sum("value").alias("value"))


def _scale(nodes, sources, by):
    n = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    k = sources.groupBy(*by).agg(F.count(F.lit(1)).alias("k"))
    both = n.join(k, by) if by else n.join(F.broadcast(k))
    return both.select(*by, (F.col("n") / F.col("k")).alias("scale"))


def _accumulate(lineage, start, steps, tail, head, by, *, keep_first):
    """Sum over all walks along ``steps`` of the start values times the shares."""
    wave, parts = start, [start] if keep_first else []
    while True:
        moved = wave.withColumnRenamed("id", tail).join(steps, [*by, "source", tail])
        wave = lineage.cut(
            moved.groupBy(*by, "source", F.col(head).alias("id")).agg(F.sum(F.col("value") * F.col("share")).alias("value"))
        )
        if wave.isEmpty():
            break
        parts.append(wave)
    if not parts:
        return start.where("false")
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy(*by, "source", "id").agg(F.sum("value").alias("value"))


def congestion(
    before: DataFrame, after: DataFrame, seeds: DataFrame, *, hops: int = 3, max_vertices: int | None = None, sample: int | None = None
) -> DataFrame:
    """Betweenness gained by nodes near the seeds: ``id, before, after, delta``."""
    from meshflux.operators.traversal import neighbourhood

    both = before.select(F.lit("before").alias("state"), "src", "dst", "distance").unionByName(
        after.select(F.lit("after").alias("state"), "src", "dst", "distance"))
    near = neighbourhood(before, seeds, hops=hops, limit=max_vertices).select("id")
    rated = betweenness(both, sample=sample, by=["state"]).join(near, "id", "left_semi")
    return rated.groupBy("id").agg(
        F.max(F.when(F.col("state") == "before", F.col("betweenness"))).alias("before"),
        F.max(F.when(F.col("state") == "after", F.col("betweenness"))).alias("after"),
    ).withColumn("delta", F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))


def group_thresholds(scores: DataFrame, group: str, value: str, percentile: float) -> DataFrame:
    """Percentile of a value per group: ``group, threshold``."""
    return quantiles(scores, value, {"threshold": percentile / 100.0}, by=[group]).drop("n")


def bottlenecks(
    scores: DataFrame, shares: DataFrame, *, ratio_min: float = EXTERNAL_RATIO_MIN, percentile: float = BETWEENNESS_PERCENTILE
) -> DataFrame:
    """Nodes that carry traffic between categories.

    ``scores(id, location, betweenness)``, ``shares(id, external_ratio, ..)``. A
    labelled node needs an external share above ``ratio_min`` and betweenness at
    its labels' least percentile; an unlabelled one must reach the overall 95 %.
    """
    whole = scores.select("id", "betweenness", "location")
    overall = quantiles(whole, "betweenness", {"usual": percentile / 100.0, "extreme": 0.95}).first()
    usual, extreme = F.lit(overall["usual"]), F.lit(overall["extreme"])
    per_label = group_thresholds(whole, "location", "betweenness", percentile).withColumnRenamed("location", "label")
    labels = whole.select("id", F.explode(F.split("location", r" \| ")).alias("label")).join(per_label, "label", "left")
    least = labels.groupBy("id").agg(F.min(F.coalesce("threshold", usual)).alias("threshold"))
    known = F.col("location") != "Unknown"
    joined = whole.join(least, "id").join(shares, "id", "left")
    gate = F.when(known, (F.col("external_ratio") > ratio_min) & (F.col("betweenness") >= F.col("threshold"))).otherwise(
        (F.col("betweenness") >= extreme) & (F.col("betweenness") > 0))
    return joined.withColumns({
        "threshold": F.when(known, F.col("threshold")).otherwise(extreme),
        "is_bottleneck": F.coalesce(gate, F.lit(False)),
    })
