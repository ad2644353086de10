"""Correlations, multiple-testing control, enrichment and overlap statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshflux.functions.ordering import positioned, ranked, running_floor
from meshflux.session import cut


def benjamini_hochberg(df: DataFrame, p: str, *, by: Sequence[str] = (), name: str = "q_value") -> DataFrame:
    """Step-up adjusted p-values within each family.

    A missing p counts as 1. Tied p-values share one q, so only the distinct
    p-values are sorted.
    """
    by = list(by)
    value = F.col(p).cast("double")
    usable = F.when(value.isNull() | F.isnan(value), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    rows = df.withColumn("_p", usable)
    tallies = rows.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_ties"))
    spots = positioned(tallies, ["_p"], by=by, amount="_ties")
    raw = spots.select(*by, "_p", (F.col("_p") * F.col("total") / (F.col("before") + F.col("_ties"))).alias("_raw"))
    steps = running_floor(raw, "_p", "_raw", by=by)
    q = steps.select(*by, "_p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("floor"))).alias(name))
    return rows.join(q, [*by, "_p"]).drop("_p")


def correlations(df: DataFrame, left: str, right: str, *, by: Sequence[str] = (), minimum: int = 20) -> DataFrame:
    """Spearman and Pearson per group; null below ``minimum`` pairs or without spread."""
    by = list(by)
    pairs = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(
        *by, F.col(left).cast("double").alias("_l"), F.col(right).cast("double").alias("_r")
    )
    with_ranks = ranked(ranked(cut(pairs), "_l", name="_lr", by=by), "_r", name="_rr", by=by)
    spread = (F.min("_l") < F.max("_l")) & (F.min("_r") < F.max("_r")) & (F.count(F.lit(1)) >= minimum)
    return with_ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(spread, F.corr("_lr", "_rr")).alias("spearman"),
        F.when(spread, F.corr("_l", "_r")).alias("pearson"),
    )


def rank_shift_summary(df: DataFrame, left: str, right: str) -> DataFrame:
    """Median, 95 % and largest absolute difference of two rank columns."""
    from meshflux.functions.ordering import quantiles

    shifts = df.select(F.abs(F.col(left) - F.col(right)).cast("double").alias("shift"))
    return quantiles(shifts, "shift", {"median_abs_shift": 0.5, "p95_abs_shift": 0.95, "max_abs_shift": 1.0}).drop("n")


def log_factorial(k: Column) -> Column:
    """``ln k!`` of a number from 0: Stirling's series, from where it has full precision."""
    x = k.cast("double") + 1.0
    shift = F.when(x < 16, F.lit(16.0)).otherwise(0.0)
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(1.0), lambda product, i: product * (x + i))
    y = x + shift
    inverse = F.lit(1.0) / y
    square = inverse * inverse
    series = inverse * (F.lit(1 / 12) - square * (F.lit(1 / 360) - square * (F.lit(1 / 1260) - square * (F.lit(1 / 1680) - square * F.lit(1 / 1188)))))
    return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + series - F.when(x < 16, F.log(steps)).otherwise(0.0)


#: Terms on either side of the largest that can change a sum: so many deviations, and so many more.
TERM_DEVIATIONS, TERM_REST = 10.0, 64


def hypergeometric_tail(df: DataFrame, overlap: str, population: str, marked: str, draws: str, *, name: str = "p_value") -> DataFrame:
    """P(X >= overlap) for each row, inside the row.

    The largest term of the tail comes from log factorials, the others from it by
    the ratio of neighbours, upwards and downwards. Terms fall off from the
    largest at least as fast as Bernstein's bound, so those beyond ten deviations
    and 64 more are below rounding; a row builds no more than these, which is the
    square root of its counts. No table of integers, no join, no shuffle.
    """
    o, n, m, d = (F.col(c).cast("bigint") for c in (overlap, population, marked, draws))
    low = F.greatest(o, m + d - n, F.lit(0).cast("bigint"))
    high = F.least(m, d)
    mode = F.floor((d + 1).cast("double") * (m + 1) / (n + 2)).cast("bigint")
    top = F.least(F.greatest(mode, low), high)
    share = F.coalesce(F.try_divide(m.cast("double"), n.cast("double")), F.lit(0.0))
    spread = F.sqrt(F.greatest(F.lit(0.0), d * share * (F.lit(1.0) - share) * F.coalesce(F.try_divide((n - d).cast("double"), (n - 1).cast("double")), F.lit(0.0))))
    width = (F.ceil(spread * TERM_DEVIATIONS) + TERM_REST).cast("bigint")
    # Names of the row's own, so that each is computed once.
    own = {"_n": n, "_m": m, "_d": d, "_low": low, "_high": high, "_top": top, "_width": width}
    rows = df.withColumns(own)
    c = {k: F.col(k) for k in own}

    def summed(places: Column, ratio) -> Column:
        start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))

        def add(so_far, i):
            t = so_far["t"] * ratio(i.cast("double"))
            return F.struct(t.alias("t"), (so_far["s"] + t).alias("s"))

        return F.coalesce(F.aggregate(places, start, add, lambda x: x["s"]), F.lit(0.0))

    rest = c["_n"] - c["_m"] - c["_d"]
    rise = lambda i: (c["_m"] - i + 1) * (c["_d"] - i + 1) / (i * (rest + i))
    fall = lambda i: i * (rest + i) / ((c["_m"] - i + 1) * (c["_d"] - i + 1))
    up = F.when(c["_top"] < c["_high"], F.sequence(c["_top"] + 1, F.least(c["_high"], c["_top"] + c["_width"])))
    down = F.when(c["_top"] > c["_low"], F.sequence(c["_top"], F.greatest(c["_low"] + 1, c["_top"] - c["_width"] + 1), F.lit(-1).cast("bigint")))

    def choose(a, b):
        return log_factorial(a) - log_factorial(b) - log_factorial(a - b)

    largest = choose(c["_m"], c["_top"]) + choose(c["_n"] - c["_m"], c["_d"] - c["_top"]) - choose(c["_n"], c["_d"])
    tail = F.least(F.lit(1.0), F.exp(largest) * (F.lit(1.0) + summed(up, rise) + summed(down, fall)))
    known = c["_n"].isNotNull() & c["_m"].isNotNull() & c["_d"].isNotNull()
    value = F.when(F.col(overlap) <= 0, 1.0).when(known & (c["_low"] <= c["_high"]), tail).when(known, 0.0)
    return rows.withColumn(name, value).drop(*own)


# Strings that stand for a missing symbol.
MISSING_WORDS = ("", "—", "nan", "None")


def clean_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """Trimmed, distinct ids without missing words."""
    trimmed = F.trim(F.col(column).cast("string"))
    return df.select(trimmed.alias(column)).where(F.col(column).isNotNull() & ~F.col(column).isin(*MISSING_WORDS)).distinct()


def over_representation(
    selected: DataFrame, background: DataFrame, memberships: DataFrame, *, top: int | None = None
) -> DataFrame:
    """Hypergeometric over-representation per library and term, with adjusted p.

    ``selected(id)``, ``background(id)``, ``memberships(library, term, id)``. Only
    members inside the background count; terms without overlap are dropped.
    """
    universe = cut(clean_ids(background))
    drawn = cut(clean_ids(selected).join(universe, "id", "left_semi"))
    population, draws = universe.count(), drawn.count()
    inside = memberships.select("library", "term", F.trim("id").alias("id")).distinct().join(universe, "id", "left_semi")
    marked = inside.join(drawn.withColumn("_hit", F.lit(True)), "id", "left")
    tested = marked.groupBy("library", "term").agg(
        F.count(F.lit(1)).alias("set_size"),
        F.count_if(F.col("_hit")).alias("matched"),
    ).where("matched > 0")
    tested = tested.withColumns({"population": F.lit(population), "draws": F.lit(draws)})
    scored = hypergeometric_tail(cut(tested), "matched", "population", "set_size", "draws")
    adjusted = benjamini_hochberg(cut(scored), "p_value", by=["library"])
    out = adjusted.withColumn("overlap", F.concat_ws("/", F.col("matched").cast("string"), F.col("set_size").cast("string")))
    if top is None:
        return out
    best = Window.partitionBy("library").orderBy("q_value", "p_value", "term")
    return out.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top).drop("_r")


def overlap_members(selected: DataFrame, background: DataFrame, memberships: DataFrame) -> DataFrame:
    """The matched members behind each term: ``library, term, id``."""
    drawn = clean_ids(selected).join(clean_ids(background), "id", "left_semi")
    return memberships.select("library", "term", F.trim("id").alias("id")).distinct().join(drawn, "id", "left_semi").select("library", "term", "id")


def set_overlap(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Intersection, union, Jaccard (null on an empty union) of two id sets."""
    a = left.select(key).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer")
    counts = both.agg(
        F.count("_a").alias("left_count"), F.count("_b").alias("right_count"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("intersection"),
        F.count(F.lit(1)).alias("union"),
    )
    return counts.withColumns({
        "jaccard": F.try_divide(F.col("intersection").cast("double"), F.col("union").cast("double")),
        "overlap_fraction": F.try_divide(
            F.col("intersection").cast("double"), F.least("left_count", "right_count").cast("double")
        ),
    })


def concordance(predicted: DataFrame, reference: DataFrame, universe: DataFrame) -> DataFrame:
    """Precision-like, recall-like, Jaccard and hypergeometric p of two sets in a universe."""
    space = universe.select("id").distinct()
    flags = (
        space.join(predicted.select("id").distinct().withColumn("_p", F.lit(True)), "id", "left")
        .join(reference.select("id").distinct().withColumn("_r", F.lit(True)), "id", "left")
    )
    counts = flags.agg(
        F.count(F.lit(1)).alias("universe"),
        F.count_if(F.col("_p")).alias("predicted"),
        F.count_if(F.col("_r")).alias("reference"),
        F.count_if(F.col("_p") & F.col("_r")).alias("intersection"),
    )
    scored = hypergeometric_tail(cut(counts), "intersection", "universe", "reference", "predicted")
    hits = F.col("intersection").cast("double")
    return scored.withColumns({
        "precision_like": F.coalesce(F.try_divide(hits, F.col("predicted")), F.lit(0.0)),
        "recall_like": F.coalesce(F.try_divide(hits, F.col("reference")), F.lit(0.0)),
        "jaccard": F.coalesce(
            F.try_divide(hits, F.col("predicted") + F.col("reference") - F.col("intersection")), F.lit(0.0)
        ),
    })


def recall_at(
    ordered: DataFrame, reference: DataFrame, ks: Sequence[int], *, perturbed: DataFrame | None = None, population: int
) -> DataFrame:
    """Recall of a reference set among the first k of ``ordered(id, position)``.

    ``expected`` is the overlap a random order would give.
    """
    if min(ks) <= 0:
        raise ValueError("recall K values must be positive")
    evaluated = reference.select("id").distinct()
    if perturbed is not None:
        evaluated = evaluated.join(perturbed.select("id"), "id", "left_anti")
    evaluated = cut(evaluated)
    size = evaluated.count()
    flagged = ordered.where(F.col("position") <= max(ks)).join(evaluated.withColumn("_hit", F.lit(1)), "id", "left")
    counted = flagged.agg(*[
        expr for k in ks for expr in (
            F.count_if(F.col("position") <= k).alias(f"n{k}"),
            F.count_if((F.col("position") <= k) & (F.col("_hit") == 1)).alias(f"h{k}"),
        )
    ])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("returned"), F.col(f"h{k}").alias("overlap")) for k in ks])
    expected = F.col("returned") * F.lit(float(size)) / F.lit(float(population))
    return counted.select(F.explode(rows).alias("r")).select("r.*").withColumns({
        "recall": F.try_divide(F.col("overlap").cast("double"), F.lit(float(size))),
        "expected": expected,
        "enrichment": F.try_divide(F.col("overlap").cast("double"), expected),
    })
