"""Audits that compare two rankings or two versions of a graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshflux.functions.inference import correlations
from meshflux.functions.measures import corroboration_bonus
from meshflux.functions.ordering import quantile_bins, quantiles, ranked, top_fraction
from meshflux.session import cut
from meshflux.settings import MEANINGFUL_PCT

# Rank cut-offs and node strata of the promotion audit.
CUTOFFS = (20, 50, 100)
DECILE_BANDS = {"Low_D1_D3": (1, 3), "Middle_D4_D7": (4, 7), "High_D8_D9": (8, 9), "D10": (10, 10)}
TOP_SHARES = {"Top10pct": 0.10, "Top5pct": 0.05, "Top1pct": 0.01}


def with_deciles(nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_decile``, ties in id order."""
    for column in columns:
        nodes = quantile_bins(nodes, [column, "id"], 10, name=f"{column}_decile")
    return nodes


def paired_ranks(reference: DataFrame, candidate: DataFrame, *, domain: str = "absolute") -> DataFrame:
    """Ranks of the ids both tables respond for, and the promotion (positive: moved up).

    ``domain`` restricts to rows that are positive, or negative, in both.
    """
    rows = reference.select("id", F.col("delta_pct").alias("reference")).join(
        candidate.select("id", F.col("delta_pct").alias("candidate")), "id")
    sides = {"absolute": lambda c: F.abs(c), "positive": lambda c: F.when(F.col(c) > 0, F.col(c)),
             "negative": lambda c: F.when(F.col(c) < 0, -F.col(c))}
    value = sides[domain]
    rows = cut(rows.withColumns({"_r": value("reference"), "_c": value("candidate")}))
    rows = ranked(rows, "_r", name="reference_rank", method="min", descending=True)
    rows = ranked(rows, "_c", name="candidate_rank", method="min", descending=True)
    rows = rows.where("reference_rank IS NOT NULL AND candidate_rank IS NOT NULL").drop("_r", "_c")
    return rows.withColumns({
        "promotion": F.col("reference_rank") - F.col("candidate_rank"), "response_delta": F.col("candidate") - F.col("reference"),
        "is_meaningful": F.greatest(F.abs("reference"), F.abs("candidate")) >= MEANINGFUL_PCT})


def strata_of(nodes: DataFrame, column: str) -> DataFrame:
    """Long table of overlapping strata: each decile, decile bands and top shares."""
    nodes = cut(nodes)
    decile = f"{column}_decile"
    labels = [F.concat(F.lit("D"), F.col(decile).cast("string"))]
    # D10 is a decile and a band of its own; it is listed once.
    labels += [F.when(F.col(decile).between(a, b), F.lit(name)) for name, (a, b) in DECILE_BANDS.items() if name != "D10"]
    rows = nodes.select("id", F.explode(F.array_compact(F.array(*labels))).alias("stratum"))
    for name, share in TOP_SHARES.items():
        flagged = top_fraction(nodes.select("id", column), [F.col(column).desc(), F.col("id").asc()], share, name="_top")
        rows = rows.unionByName(flagged.where("_top").select("id", F.lit(name).alias("stratum")))
    return rows


def promotion_summary(ranks: DataFrame, strata: DataFrame) -> DataFrame:
    """Median and mean promotion, share promoted, shares entering and leaving the top, per stratum."""
    rows = cut(ranks.join(strata, "id"))
    entered = {f"entering_top{k}": F.avg(((F.col("candidate_rank") <= k) & (F.col("reference_rank") > k)).cast("double")) for k in CUTOFFS}
    left = {f"leaving_top{k}": F.avg(((F.col("reference_rank") <= k) & (F.col("candidate_rank") > k)).cast("double")) for k in CUTOFFS}
    shares = rows.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("nodes"), F.avg("promotion").alias("mean_promotion"),
        F.avg((F.col("promotion") > 0).cast("double")).alias("promoted_share"),
        *[e.alias(n) for n, e in (entered | left).items()])
    median = quantiles(rows, "promotion", {"median_promotion": 0.5}, by=["stratum"]).drop("n")
    return shares.join(median, "stratum")


def matched_difference(ranks: DataFrame, nodes: DataFrame, *, coverage: str, deciles: tuple[str, str], minimum: int = 10) -> DataFrame:
    """Within degree x rank bins: median promotion above the median coverage minus at or below it.

    Small bins and bins without a spread of coverage are skipped.
    """
    key = F.concat_ws("|", *[F.concat(F.lit("D"), F.col(d).cast("string")) for d in deciles])
    rows = cut(ranks.join(nodes, "id").select(key.alias("match_bin"), "promotion", F.col(coverage).cast("double").alias("coverage")))
    middle = quantiles(rows, "coverage", {"middle": 0.5}, by=["match_bin"])
    sided = rows.join(middle.where(F.col("n") >= minimum), "match_bin").withColumn("side", F.when(F.col("coverage") > F.col("middle"), "high").otherwise("low"))
    sided = cut(sided)
    medians = quantiles(sided, "promotion", {"median": 0.5}, by=["match_bin", "side"])
    return medians.groupBy("match_bin").agg(
        F.max(F.when(F.col("side") == "high", F.col("n"))).alias("high_n"), F.max(F.when(F.col("side") == "low", F.col("n"))).alias("low_n"),
        F.max(F.when(F.col("side") == "high", F.col("median"))).alias("high_median"),
        F.max(F.when(F.col("side") == "low", F.col("median"))).alias("low_median"),
    ).where("high_n IS NOT NULL AND low_n IS NOT NULL").withColumn("difference", F.col("high_median") - F.col("low_median"))


def sign_vote(conditions: DataFrame, values: Sequence[str], *, needed: int = 6) -> DataFrame:
    """Warn when enough conditions move the same way in a measure."""
    counts = conditions.agg(*[F.count_if(F.col(v) > 0).alias(f"{v}_promoted") for v in values],
                            *[F.count_if(F.col(v) < 0).alias(f"{v}_demoted") for v in values])
    warn = F.lit(False)
    for v in values:
        warn = warn | (F.col(f"{v}_promoted") >= needed)
    return counts.withColumn("judgment", F.when(warn, "BIAS_WARNING").otherwise("PARTIAL"))


def band_audit(edges: DataFrame, *, meaningful: float = 1.001) -> DataFrame:
    """Bonus by evidence tertile: count, meaningful share, median and 95 %."""
    rows = cut(quantile_bins(edges.select("src", "dst", "s_nontext", "text_bonus").dropna(), ["s_nontext", "src", "dst"], 3, name="b"))
    rows = rows.withColumn("band", F.element_at(F.array(F.lit("LOW"), F.lit("MID"), F.lit("HIGH")), F.col("b")))
    share = rows.groupBy("band").agg(F.avg((F.col("text_bonus") >= meaningful).cast("double")).alias("meaningful_share"))
    spread = quantiles(rows, "text_bonus", {"median_bonus": 0.5, "p95_bonus": 0.95}, by=["band"]).withColumnRenamed("n", "edges")
    return share.join(spread, "band")


# Half-saturation points and bonus strengths of the sensitivity grid.
GRID_K = (0.4, 0.6, 0.8)
GRID_STRENGTH = (0.0, 0.025, 0.05, 0.075, 0.10)


def bonus_grid(edges: DataFrame, *, meaningful: float = 1.001) -> DataFrame:
    """Bonus spread for every grid point and evidence tertile: 45 rows."""
    rows = quantile_bins(edges.select("src", "dst", F.coalesce("s_nontext", F.lit(0.0)).alias("e"), F.coalesce("text", F.lit(0.0)).alias("t")),
                         ["e", "src", "dst"], 3, name="b")
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("strength")) for k in GRID_K for s in GRID_STRENGTH])
    every = rows.select("e", "t", "b", F.explode(grid).alias("g")).select(
        F.element_at(F.array(F.lit("LOW"), F.lit("MID"), F.lit("HIGH")), F.col("b")).alias("band"), "g.k", "g.strength",
        corroboration_bonus("e", "t", k_text=F.col("g.k"), k_evidence=F.col("g.k"), strength=F.col("g.strength")).alias("bonus"))
    every = cut(every)
    by = ["k", "strength", "band"]
    share = every.groupBy(*by).agg(F.avg((F.col("bonus") >= meaningful).cast("double")).alias("meaningful_share"))
    return share.join(quantiles(every, "bonus", {"median_bonus": 0.5, "p95_bonus": 0.95, "max_bonus": 1.0}, by=by).drop("n"), by)


def graph_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs on one side only, and the largest absolute and relative weight difference."""
    pair = lambda df, name: df.select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").alias(name))
    both = pair(left, "a").join(pair(right, "b"), ["src", "dst"], "full_outer")
    gap = F.abs(F.col("a") - F.col("b"))
    edges = both.agg(
        F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_abs_difference"),
        F.coalesce(F.max(gap / F.greatest(F.abs("a"), F.lit(1e-12))), F.lit(0.0)).alias("max_rel_difference"))
    ids = lambda df, name: df.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn(name, F.lit(1))
    nodes = ids(left, "a").join(ids(right, "b"), "id", "full_outer").agg(
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("nodes_on_one_side"))
    return edges.join(F.broadcast(nodes))  # two one-row tables


def benchmark(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Agreement of two response tables: correlations, sign flips, top overlaps."""
    rows = reference.select("id", F.col("delta_pct").alias("a")).join(candidate.select("id", F.col("delta_pct").alias("b")), "id")
    rows = cut(rows.withColumns({"pa": F.when(F.col("a") > 0, F.col("a")), "pb": F.when(F.col("b") > 0, F.col("b")),
                                 "na": F.when(F.col("a") < 0, -F.col("a")), "nb": F.when(F.col("b") < 0, -F.col("b")),
                                 "aa": F.abs("a"), "ab": F.abs("b")}))
    meaningful = F.greatest("aa", "ab") >= MEANINGFUL_PCT
    out = rows.agg(F.count_if(meaningful).alias("meaningful"), F.count_if(meaningful & (F.signum("a") != F.signum("b"))).alias("sign_flips"))
    out = out.join(F.broadcast(correlations(rows, "a", "b", minimum=2)))  # one-row tables throughout
    for label, x, y, sizes in (("positive", "pa", "pb", (20, 50)), ("negative", "na", "nb", (20, 50)), ("absolute", "aa", "ab", (50, 100))):
        for size in sizes:
            first = rows.where(F.col(x).isNotNull()).orderBy(F.desc(x), "id").limit(size).select("id")
            second = rows.where(F.col(y).isNotNull()).orderBy(F.desc(y), "id").limit(size).select("id")
            shared = first.join(second, "id", "left_semi").agg(F.count(F.lit(1)).alias(f"{label}_top{size}_overlap"))
            out = out.join(F.broadcast(shared))
    return out


def snapshot_difference(reference: DataFrame, current: DataFrame, *, rtol: float = 1e-10, atol: float = 1e-14) -> DataFrame:
    """Entries of two flattened snapshots ``(path, number, text)`` that disagree."""
    a = reference.select("path", F.col("number").alias("number_a"), F.col("text").alias("text_a"), F.lit(True).alias("_a"))
    b = current.select("path", F.col("number").alias("number_b"), F.col("text").alias("text_b"), F.lit(True).alias("_b"))
    both = a.join(b, "path", "full_outer")
    close = F.abs(F.col("number_a") - F.col("number_b")) <= F.lit(atol) + F.lit(rtol) * F.greatest(F.abs("number_a"), F.abs("number_b"))
    kind = (
        F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected")
        .when(F.col("number_a").isNotNull() & F.col("number_b").isNotNull() & ~close, "number")
        .when(~F.col("text_a").eqNullSafe(F.col("text_b")), "text"))
    return both.withColumn("difference", kind).where("difference IS NOT NULL").select("path", "difference")


def table_parity(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact, matched and missing rows between two tables, with the largest difference."""
    keys = list(keys)
    a = left.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    both = a.join(b, keys, "left")
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_r")).alias("matched"),
        F.count_if(F.col("_r") & (F.col("_a") == F.col("_b"))).alias("exact"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"))
