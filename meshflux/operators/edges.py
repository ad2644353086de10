"""Filtering, weighting and summarising edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshflux.functions.measures import strength_to_distance
from meshflux.functions.ordering import weighted_quantiles
from meshflux.operators.propagation import symmetric_arcs
from meshflux.session import cut
from meshflux.settings import BONUS, FORCED_DISTANCE_SCALE, PENALTY

MIN_WEIGHT = 1e-9
FAR = 1e9


def keep_in_context(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among ``members(id)``."""
    ids = members.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    ).select(*edges.columns)


def attach_levels(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """Add the level of either end as ``level_src`` and ``level_dst``; unknown counts as 1."""
    neutral = lambda c: F.coalesce(F.col(c), F.lit(1.0)).cast("double").alias(c)
    left = levels.select(F.col("id").alias("src"), F.col("level").alias("level_src"))
    right = levels.select(F.col("id").alias("dst"), F.col("level").alias("level_dst"))
    joined = edges.join(left, "src", "left").join(right, "dst", "left")
    return joined.select(*edges.columns, neutral("level_src"), neutral("level_dst"))


def _one_row(df: DataFrame, *aggregates: Column):
    return df.agg(*aggregates).first()


def weigh_edges(
    edges: DataFrame,
    *,
    mode: str = "within_context",
    pooled_levels: DataFrame | None = None,
) -> DataFrame:
    """Weight and distance of scored edges that carry the level of their ends.

    ``within_context`` scales the geometric mean of the levels over the kept
    edges. ``comparable`` scales every end against one pooled reference, so that
    weights of different contexts share a scale.
    """
    if mode == "within_context":
        floor = lambda c: F.greatest(F.col(c), F.lit(0.01))
        raw = F.sqrt(floor("level_src") * floor("level_dst"))
        span = _one_row(edges, F.min(raw).alias("low"), F.max(raw).alias("high"))
        if span["low"] is not None and span["high"] > span["low"]:
            share = (raw - F.lit(span["low"])) / F.lit(span["high"] - span["low"])
            multiplier = F.lit(0.1) + F.lit(0.9) * share
        else:
            multiplier = F.lit(1.0)
    elif mode == "comparable":
        if pooled_levels is None:
            raise ValueError("mode comparable needs pooled_levels")
        reference = pooled_reference(pooled_levels)
        multiplier = comparable_multiplier(F.col("level_src"), F.col("level_dst"), reference["q01"], reference["q99"])
    else:
        raise ValueError("mode must be within_context or comparable")
    weight = F.greatest(F.pow(F.col("score") / F.lit(1000.0), F.lit(2.0)) * multiplier, F.lit(MIN_WEIGHT))
    return edges.withColumn("multiplier", multiplier).withColumn("weight", weight).withColumn(
        "distance", F.lit(1.0) / F.col("weight")
    )


def pooled_reference(levels: DataFrame) -> dict[str, float]:
    """1 % and 99 % weighted quantile of log levels over all contexts."""
    positive = levels.where(F.col("level") > 0)
    tallies = positive.groupBy(F.log1p(F.col("level").cast("double")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    row = weighted_quantiles(tallies, "value", "n", {"q01": 0.01, "q99": 0.99}).first()
    if row is None or row["q01"] is None:
        return {"q01": 0.0, "q99": 1.0}
    low, high = row["q01"], row["q99"]
    return {"q01": low, "q99": high if high > low else low + 1.0}


def comparable_multiplier(first: Column, second: Column, q01: float, q99: float) -> Column:
    """0.1 + 0.9 x geometric mean of the ends' clipped, log-scaled levels."""
    def scaled(level):
        share = (F.log1p(F.greatest(level, F.lit(0.0))) - F.lit(q01)) / F.lit(q99 - q01)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))

    return F.lit(0.1) + F.lit(0.9) * F.sqrt(scaled(first) * scaled(second))


def mask_unreachable(edges: DataFrame, column: str = "distance") -> DataFrame:
    """Infinite distances become twice the largest finite one (1e9 if none is finite)."""
    distance = F.col(column)
    finite = distance.isNotNull() & ~F.isnan(distance) & (distance < F.lit(float("inf")))
    top = _one_row(edges, F.max(F.when(finite, distance)).alias("top"))["top"]
    return edges.withColumn(column, F.when(finite, distance).otherwise(F.lit(FAR if top is None else 2.0 * top)))


def simplify(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per unordered pair (and ``by``): loops dropped, best weight, least distance, first flag."""
    flag = F.col("is_bridge") if "is_bridge" in edges.columns else F.lit(False)
    distance = F.col("distance") if "distance" in edges.columns else strength_to_distance(F.col("weight"))
    pairs = edges.where(F.col("src") != F.col("dst")).select(
        *by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"),
        "weight", distance.alias("distance"), flag.alias("is_bridge"),
    )
    return pairs.groupBy(*by, "src", "dst").agg(
        F.max("weight").alias("weight"), F.min("distance").alias("distance"), F.bool_or("is_bridge").alias("is_bridge")
    )


def context_graph(
    interactions: DataFrame,
    levels: DataFrame | None = None,
    *,
    context: str | None = None,
    threshold: int = 500,
    mode: str = "within_context",
) -> DataFrame:
    """The weighted undirected graph of one context: ``src, dst, weight, distance, is_bridge``."""
    from meshflux.sources.tables import context_scan, edge_scan

    edges = edge_scan(interactions, threshold)
    if context is None:
        edges = edges.withColumns({"level_src": F.lit(1.0), "level_dst": F.lit(1.0)})
    else:
        members = context_scan(levels, context)
        edges = attach_levels(keep_in_context(edges, members), members)
    # The span of the levels and the result both read the edges. Weights have a floor, so no distance is infinite.
    return simplify(weigh_edges(cut(edges), mode=mode, pooled_levels=levels))


def context_graphs(interactions: DataFrame, levels: DataFrame, *, threshold: int = 500) -> DataFrame:
    """The graphs of all contexts on their common scale: ``context, src, dst, weight, distance, is_bridge``.

    The rows of ``context_graph(mode="comparable")`` for every context at once: the
    interactions are read once, and the context is part of the keys.
    """
    from meshflux.sources.tables import context_scan, edge_scan

    members = context_scan(levels, None)
    left = members.select("context", F.col("id").alias("src"), F.col("level").cast("double").alias("level_src"))
    right = members.select("context", F.col("id").alias("dst"), F.col("level").cast("double").alias("level_dst"))
    edges = edge_scan(interactions, threshold).join(left, "src").join(right, ["context", "dst"])
    return simplify(weigh_edges(edges, mode="comparable", pooled_levels=levels), by=["context"])


def degree_summary(edges: DataFrame, *, distinct: bool = True) -> DataFrame:
    """Degree and best score per id, counting partners (or rows)."""
    ends = symmetric_arcs(edges, "score")
    if distinct:
        ends = ends.groupBy("src", "dst").agg(F.max("score").alias("score"))
    return ends.groupBy(F.col("src").alias("id")).agg(
        F.count(F.lit(1)).alias("degree"), F.max("score").alias("max_score")
    )


def category_traffic(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edge count per unordered pair of end labels, and whether the pair is internal."""
    left = labels.select(F.col("id").alias("src"), F.col("location").alias("a"))
    right = labels.select(F.col("id").alias("dst"), F.col("location").alias("b"))
    named = edges.join(left, "src", "left").join(right, "dst", "left").select(
        F.coalesce("a", F.lit("Unknown")).alias("a"), F.coalesce("b", F.lit("Unknown")).alias("b")
    )
    return named.groupBy(F.least("a", "b").alias("location_a"), F.greatest("a", "b").alias("location_b")).agg(
        F.count(F.lit(1)).alias("edges")
    ).withColumn("is_internal", F.col("location_a") == F.col("location_b"))


def traffic_matrix(traffic: DataFrame, locations: list[str]) -> DataFrame:
    """Symmetric location x location matrix of edge counts."""
    swapped = traffic.where(~F.col("is_internal")).select(
        F.col("location_b").alias("location_a"), F.col("location_a").alias("location_b"), "edges"
    )
    both = traffic.select("location_a", "location_b", "edges").unionByName(swapped)
    return both.groupBy("location_a").pivot("location_b", locations).agg(F.sum("edges")).fillna(0)


def contingency(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Two-way count table over declared column values."""
    return rows.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0, [str(v) for v in values])


def neighbour_shares(arcs: DataFrame, labels: DataFrame, *, separator: str = " | ") -> DataFrame:
    """Per id: share of edge weight that leaves its own labels, and its top three neighbour labels.

    Unlabelled neighbours do not count. Labels are joined lists such as ``A | B``.
    """
    known = labels.where(F.col("location") != "Unknown").select(
        F.col("id"), F.split("location", F.lit(r" \| ")).alias("labels")
    )
    own = known.select(F.col("id").alias("src"), F.col("labels").alias("own"))
    other = known.select(F.col("id").alias("dst"), F.col("labels").alias("theirs"))
    seen = arcs.join(own, "src").join(other, "dst")
    totals = seen.groupBy("src").agg(
        F.sum("weight").alias("total"),
        F.sum(F.when(F.arrays_overlap("own", "theirs"), 0.0).otherwise(F.col("weight"))).alias("outside"),
    )
    by_label = seen.select("src", "weight", F.explode(F.array_distinct("theirs")).alias("label")).groupBy("src", "label").agg(
        F.sum("weight").alias("part")
    )
    # Labels per id are few (a controlled vocabulary), so the list stays small.
    best = by_label.groupBy("src").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("part")).alias("order"), "label"))), 1, 3).alias("best")
    ).select("src", F.array_join(F.transform("best", lambda b: F.format_string("%s:%.2f", b["label"], -b["order"])), ", ").alias("neighbour_labels"))
    return totals.join(best, "src").select(
        F.col("src").alias("id"), (F.col("outside") / F.col("total")).alias("external_ratio"), "neighbour_labels"
    )


def suppressed(edges: DataFrame, targets: DataFrame, factor: float, *, mode: str = "incident") -> DataFrame:
    """Arcs or edges touching ``targets(id)`` with their weight multiplied once.

    ``mode``: ``incident`` (either end), ``outgoing`` (src) or ``incoming`` (dst).
    """
    if not 0.0 <= factor <= 1.0:
        raise ValueError("factor must be between 0 and 1")
    ids = targets.select("id").distinct()
    marked = edges
    ends = {"incident": ["src", "dst"], "outgoing": ["src"], "incoming": ["dst"]}[mode]
    for end in ends:
        marked = marked.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    hit = F.coalesce(*[F.col(f"_{end}") for end in ends], F.lit(False))
    weight = F.when(hit, F.col("weight") * F.lit(factor)).otherwise(F.col("weight"))
    out = marked.select(*[c for c in edges.columns if c not in ("weight", "distance")], weight.alias("weight"))
    return out.withColumn("distance", strength_to_distance(F.col("weight")))


def cap_forced_distances(edges: DataFrame, targets: DataFrame, *, scale: float = FORCED_DISTANCE_SCALE) -> DataFrame:
    """Distances of edges touching the targets, held to ``scale`` x the mean distance."""
    mean = _one_row(edges, F.avg("distance").alias("m"))["m"]
    limit = F.lit((1.0 if mean is None else mean) * scale)
    ids = targets.select("id").distinct()
    marked = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(
        ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left"
    )
    hit = F.coalesce("_s", "_d", F.lit(False))
    capped = F.when(hit, F.least("distance", limit)).otherwise(F.col("distance"))
    return marked.select(*[c for c in edges.columns if c != "distance"], capped.alias("distance"))


def apply_factors(edges: DataFrame, factors: DataFrame) -> DataFrame:
    """Edge weights times the product of all factors listed for their pair.

    ``factors(src, dst, factor)`` may name a pair in either order and repeat it.
    """
    product = factors.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.exp(F.sum(F.log("factor"))).alias("factor")
    )
    joined = edges.join(product, ["src", "dst"], "left")
    weight = F.col("weight") * F.coalesce("factor", F.lit(1.0))
    out = joined.select(*[c for c in edges.columns if c not in ("weight", "distance")], weight.alias("weight"))
    return out.withColumn("distance", strength_to_distance(F.col("weight")))


def bonus_factors(edges: DataFrame, targets: DataFrame, regulated: DataFrame, groups: DataFrame, *, bonus: float = BONUS) -> DataFrame:
    """Factor rows for target edges: target regulates the neighbour, or shares a complex with it.

    ``regulated(regulator, id)``, ``groups(id, group)``. An edge can earn both.
    """
    arcs = symmetric_arcs(edges).join(targets.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    direct = arcs.join(regulated.select(F.col("regulator").alias("src"), F.col("id").alias("dst")).distinct(), ["src", "dst"], "left_semi")
    mine = groups.select(F.col("id").alias("src"), "group")
    theirs = groups.select(F.col("id").alias("dst"), "group")
    same = arcs.join(mine, "src").join(theirs, ["dst", "group"]).select("src", "dst").distinct()
    factor = F.lit(1.0 + bonus).alias("factor")
    return direct.select("src", "dst", factor).unionByName(same.select("src", "dst", factor))


def penalty_factors(edges: DataFrame, targets: DataFrame, classes: DataFrame, *, penalty: float = PENALTY) -> DataFrame:
    """Factor rows for target edges whose ends share an informative class."""
    arcs = symmetric_arcs(edges).join(targets.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    useful = classes.where(~F.col("class").isin("Unknown", "Other"))
    mine = useful.select(F.col("id").alias("src"), "class")
    theirs = useful.select(F.col("id").alias("dst"), "class")
    return arcs.join(mine, "src").join(theirs, ["dst", "class"]).select("src", "dst", F.lit(1.0 - penalty).alias("factor"))
