"""Ranks, bins and exact quantiles without a single-task global sort.

A window with no partition key pulls the whole table into one task. Here the
rows are range-partitioned on the sort key, every row remembers its partition,
and a per-partition offset turns the local position into the global one. The
laid-out table is written once (``cut``) because the sampled range boundaries
must not change between the two reads of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshflux.session import cut, shuffle_partitions


def positioned(
    df: DataFrame,
    order: Sequence[str | Column],
    *,
    by: Sequence[str] = (),
    amount: str | None = None,
) -> DataFrame:
    """Add ``before`` and ``total``: the amount ahead of a row, and in its group.

    ``amount`` defaults to one per row. A hot ``by`` key is spread over many
    range partitions, since the range runs over ``by`` and ``order`` together.
    """
    by = list(by)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = shuffle_partitions(df.sparkSession)
    laid = cut(
        df.repartitionByRange(parts, *[F.col(c) for c in by], *order)
        .withColumn("_part", F.spark_partition_id())
    )
    size = F.sum(F.col(amount)) if amount else F.count(F.lit(1))
    sizes = laid.groupBy(*by, "_part").agg(size.alias("_size"))
    over_parts = Window.partitionBy(*by).orderBy("_part")
    whole = over_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        *by,
        "_part",
        (F.sum("_size").over(over_parts) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(whole).alias("total"),
    )
    step = F.col(amount) if amount else F.lit(1)
    local = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        laid.join(offsets, [*by, "_part"])
        .withColumn("before", F.col("_offset") + F.sum(step).over(local) - step)
        .drop("_part", "_offset")
    )


def row_numbers(
    df: DataFrame, order: Sequence[str | Column], *, by: Sequence[str] = (), name: str = "row_number"
) -> DataFrame:
    """Global (or per-group) 1-based row number; ``order`` must be a total order."""
    return positioned(df, order, by=by).withColumn(name, F.col("before") + 1).drop("before", "total")


def ranked(
    df: DataFrame,
    value: str,
    *,
    name: str = "rank",
    by: Sequence[str] = (),
    method: str = "average",
    descending: bool = False,
) -> DataFrame:
    """Rank of ``value``; nulls get a null rank. Only distinct values are sorted."""
    by = list(by)
    tallies = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    spots = positioned(tallies, order, by=by, amount="_ties")
    rank = {
        "average": F.col("before") + (F.col("_ties") + 1) / 2.0,
        "min": F.col("before") + 1,
        "max": F.col("before") + F.col("_ties"),
    }[method]
    looked_up = spots.select(*by, value, rank.alias(name))
    return df.join(looked_up, [*by, value], "left")


def rank_percentile(rank: Column | str, count: Column | str) -> Column:
    """1 for the first rank, 0 for the last; a lone row scores 1."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    count = F.col(count) if isinstance(count, str) else count
    return F.when(rank.isNull(), None).when(count == 1, 1.0).otherwise(1.0 - (rank - 1.0) / (count - 1.0))


def quantiles(df: DataFrame, value: str, probs: dict[str, float], *, by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per ``by`` group.

    ``F.percentile`` keeps the value histogram of a group in one task; this keeps
    one row per distinct value spread over the cluster.
    """
    present = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    tallies = present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    return tally_quantiles(tallies, value, "_ties", probs, by=by)


def tally_quantiles(tallies: DataFrame, value: str, ties: str, probs: dict[str, float], *, by: Sequence[str] = ()) -> DataFrame:
    """The same from one row per distinct value with its number of rows."""
    by = list(by)
    spots = positioned(tallies.withColumnRenamed(ties, "_ties"), [value], by=by, amount="_ties")
    picks = []
    for name, prob in probs.items():
        at = (F.col("total") - 1) * F.lit(float(prob))
        low, high = F.floor(at), F.ceil(at)
        holds_low = (F.col("before") <= low) & (low < F.col("before") + F.col("_ties"))
        holds_high = (F.col("before") <= high) & (high < F.col("before") + F.col("_ties"))
        picks += [
            F.max(F.when(holds_low, F.col(value))).alias(f"_{name}_low"),
            F.max(F.when(holds_high, F.col(value))).alias(f"_{name}_high"),
            F.max(at - low).alias(f"_{name}_part"),
        ]
    rows = spots.groupBy(*by).agg(*picks, F.max("total").alias("n"))
    return rows.select(
        *by,
        "n",
        *[
            (F.col(f"_{n}_low") + F.col(f"_{n}_part") * (F.col(f"_{n}_high") - F.col(f"_{n}_low"))).alias(n)
            for n in probs
        ],
    )


def weighted_quantiles(df: DataFrame, value: str, count: str, probs: dict[str, float], *, by: Sequence[str] = ()) -> DataFrame:
    """Smallest value whose running count reaches the quantile of the total count."""
    by = list(by)
    tallies = df.groupBy(*by, value).agg(F.sum(count).alias("_ties"))
    spots = positioned(tallies, [value], by=by, amount="_ties")
    reached = F.col("before") + F.col("_ties")
    return spots.groupBy(*by).agg(*[
        F.min(F.when(reached >= F.col("total") * F.lit(float(p)), F.col(value))).alias(n) for n, p in probs.items()
    ])


def quantile_bins(
    df: DataFrame, order: Sequence[str | Column], bins: int, *, by: Sequence[str] = (), name: str = "bin"
) -> DataFrame:
    """Equal-count bins over first-occurrence ranks, with linear bin edges.

    Row ``r`` of ``n`` falls in bin ``ceil((r-1) * bins / (n-1))``, at least 1.
    The sort key must be total; callers append the id to break ties.
    """
    spots = positioned(df, order, by=by)
    place = F.ceil(F.col("before") * F.lit(bins) / F.greatest(F.col("total") - 1, F.lit(1)))
    return spots.withColumn(name, F.greatest(place, F.lit(1)).cast("int")).drop("before", "total")


def top_fraction(df: DataFrame, order: Sequence[str | Column], fraction: float, *, by: Sequence[str] = (), name: str) -> DataFrame:
    """Flag the first ``ceil(n * fraction)`` rows of the order."""
    spots = positioned(df, order, by=by)
    return spots.withColumn(name, F.col("before") < F.ceil(F.col("total") * F.lit(fraction))).drop("before", "total")


def running_floor(df: DataFrame, key: str, value: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Add ``floor``: the least ``value`` among rows with an equal or larger ``key``.

    ``key`` must be unique within a group. Used for step-up adjustments.
    """
    by = list(by)
    parts = shuffle_partitions(df.sparkSession)
    laid = cut(
        df.repartitionByRange(parts, *[F.col(c) for c in by], F.col(key))
        .withColumn("_part", F.spark_partition_id())
    )
    lows = laid.groupBy(*by, "_part").agg(F.min(value).alias("_low"))
    later = Window.partitionBy(*by).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tails = lows.select(*by, "_part", F.min("_low").over(later).alias("_tail"))
    local = Window.partitionBy(*by, "_part").orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        laid.join(tails, [*by, "_part"])
        .withColumn("floor", F.least(F.min(value).over(local), F.col("_tail")))
        .drop("_part", "_tail")
    )
