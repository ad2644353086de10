"""Node scores: rank-blend importance, tiers, composite scores, rank comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshflux.functions.measures import clip01
from meshflux.functions.ordering import quantiles, ranked, rank_percentile
from meshflux.session import cut
from meshflux.settings import (
    NOISE_MAX_DEGREE, NOISE_MAX_SCORE, NOISE_RANK_PERCENTILE, TIER_BRIDGE, TIER_STRATEGIC, TIER_TOP,
)


def importance(nodes: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """100 x (0.6 PageRank rank share + 0.4 log-degree rank share), ties averaged."""
    by = list(by)
    rows = cut(nodes.withColumn("log_degree", F.log10(F.col("degree") + F.lit(1.0))))
    both = ranked(ranked(rows, "pagerank", name="_pr", by=by), "log_degree", name="_dr", by=by)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    both = both.join(sizes, by) if by else both.join(F.broadcast(sizes))  # one row without keys
    out = both.withColumns({
        "pagerank_share": F.col("_pr") / F.col("_n"), "degree_share": F.col("_dr") / F.col("_n"),
    })
    blend = (F.lit(0.60) * F.col("pagerank_share") + F.lit(0.40) * F.col("degree_share")) * F.lit(100.0)
    return out.withColumn("importance", blend).drop("_pr", "_dr", "_n", "log_degree")


def tiers(scores: DataFrame) -> DataFrame:
    """Label each node ``noise``, ``top``, ``strategic``, ``bridge`` or ``peripheral``."""
    cut_off = quantiles(scores, "pagerank_share", {"low": NOISE_RANK_PERCENTILE / 100.0}).first()["low"]
    noise = (
        (F.col("degree") <= NOISE_MAX_DEGREE) & (F.col("max_score") < NOISE_MAX_SCORE)
        & (F.col("pagerank_share") <= F.lit(cut_off))
    )
    s = F.col("importance")
    return scores.withColumn(
        "tier",
        F.when(noise, "noise").when(s >= TIER_TOP, "top").when(s >= TIER_STRATEGIC, "strategic")
        .when(s >= TIER_BRIDGE, "bridge").otherwise("peripheral"),
    )


# Term, weight, low, high of the composite score.
COMPOSITE_TERMS = (
    ("nds", 0.25, 0.20, 0.81),
    ("mean_plddt", 0.20, 26.0, 99.0),
    ("sasa", 0.15, 1700.0, 330000.0),
    ("compactness", 0.10, 0.0, 1.0),
    ("hydrophobic_ratio", 0.05, 0.0, 1.0),
    ("charged_ratio", 0.05, 0.0, 1.0),
)
COMPOSITE_COUNT = ("num_ligands", 0.20, 1000.0)


def composite_score(rows: DataFrame, *, scope: str = "all") -> DataFrame:
    """Weighted sum of clipped min-max features plus a log count bonus, times 100.

    Absent feature columns and null features score zero. ``scope`` limits the
    score to ``gates`` (is_bottleneck) or ``stressed`` (role responder) rows;
    others get null.
    """
    total = F.lit(0.0)
    for name, weight, low, high in COMPOSITE_TERMS:
        if name in rows.columns:
            share = (F.col(name).cast("double") - F.lit(low)) / F.lit(high - low)
            total = total + F.lit(weight) * F.coalesce(clip01(share), F.lit(0.0))
    name, weight, full = COMPOSITE_COUNT
    if name in rows.columns:
        count = F.col(name).cast("double")
        bonus = F.when(count > 0, F.least(F.lit(1.0), F.log10(count + 1.0) / F.log10(F.lit(full)))).otherwise(0.0)
        total = total + F.lit(weight) * bonus
    wanted: dict[str, Column] = {
        "all": F.lit(True),
        "gates": F.col("is_bottleneck") if "is_bottleneck" in rows.columns else F.lit(False),
        "stressed": F.col("role") == "responder" if "role" in rows.columns else F.lit(False),
    }
    return rows.withColumn("composite_score", F.when(wanted[scope], total * F.lit(100.0)))


def response_ranks(responses: DataFrame, *, value: str = "delta_pct", prefix: str = "") -> DataFrame:
    """Competition ranks over all, positive and negative responses, with percentiles.

    A row outside a domain has a null rank there.
    """
    v = F.col(value)
    rows = cut(responses.withColumns({
        "_abs": F.abs(v), "_pos": F.when(v > 0, v), "_neg": F.when(v < 0, -v),
    }))
    for column, name in (("_abs", "absolute_rank"), ("_pos", "positive_rank"), ("_neg", "negative_rank")):
        rows = ranked(rows, column, name=prefix + name, method="min", descending=True)
    counts = responses.agg(
        F.count(v).alias("_na"), F.count_if(v > 0).alias("_np"), F.count_if(v < 0).alias("_nn"))
    rows = rows.join(F.broadcast(counts))  # one row
    for name, count in (("absolute_rank", "_na"), ("positive_rank", "_np"), ("negative_rank", "_nn")):
        rows = rows.withColumn(prefix + name + "_percentile", rank_percentile(prefix + name, count))
    return rows.drop("_abs", "_pos", "_neg", "_na", "_np", "_nn")


def quartile_groups(scores: DataFrame, *, top: int = 10) -> DataFrame:
    """Rows that respond although not central, and central rows that hardly respond."""
    rows = cut(scores.withColumn("_abs", F.abs("delta_pct")))
    d = quantiles(rows, "delta_pct", {"q75": 0.75}).first()
    a = quantiles(rows, "_abs", {"q50": 0.50}).first()
    s = quantiles(rows, "importance", {"q50": 0.50, "q75": 0.75}).first()
    sensitive = (F.col("delta_pct") >= F.lit(d["q75"])) & (F.col("importance") <= F.lit(s["q50"]))
    steady = (F.col("importance") >= F.lit(s["q75"])) & (F.col("_abs") <= F.lit(a["q50"]))
    first = rows.where(sensitive).orderBy(F.desc("delta_pct"), "id").limit(top).withColumn("group", F.lit("sensitive_not_central"))
    second = rows.where(steady).orderBy(F.desc("importance"), "id").limit(top).withColumn("group", F.lit("central_but_weak"))
    return first.unionByName(second).drop("_abs")
