"""Scans of the scored-interaction and context-level tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshflux.schema import require_columns
from meshflux.settings import SCORE_THRESHOLD

# Taxon prefixes that identifiers may carry.
PREFIXES = ("9606.", "10090.")


def strip_prefix(column: str | Column) -> Column:
    """Identifier without its taxon prefix."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(column, r"^(9606|10090)\.", "")


def edge_scan(interactions: DataFrame, threshold: int = SCORE_THRESHOLD) -> DataFrame:
    """Interactions at or above a score; the predicate reaches the file scan."""
    require_columns(interactions, "src", "dst", "score", what="interactions")
    return interactions.where(F.col("score") >= threshold).select(
        strip_prefix("src").alias("src"), strip_prefix("dst").alias("dst"), F.col("score").cast("int").alias("score")
    )


def context_scan(levels: DataFrame, context: str | None) -> DataFrame:
    """Highest positive level per id in one context, or per context and id without one."""
    require_columns(levels, "id", "context", "level", what="context levels")
    kept, keys = levels.where(F.col("level") > 0), ["context", "id"]
    if context is not None:
        kept, keys = kept.where(F.col("context") == context), ["id"]
    return kept.groupBy(*keys).agg(F.max("level").alias("level"))


def entity_profile(levels: DataFrame, entity: str) -> DataFrame:
    """Highest level of one id in every context, strongest first."""
    kept = levels.where((F.col("id") == entity) & (F.col("level") > 0))
    return kept.groupBy("context").agg(F.max("level").alias("level")).orderBy(F.desc("level"), "context")


def canonical_targets(targets: Sequence[str], available: DataFrame) -> DataFrame:
    """Requested ids as they occur in ``available(id)``: ``position, requested, id``.

    Each request is tried as given, then without either prefix; the first form
    that exists wins, and an id requested twice keeps its first position.
    """
    spark = available.sparkSession
    forms = [
        (place, str(raw), order, form)
        for place, raw in enumerate(targets)
        for order, form in enumerate([str(raw)] + [str(raw).removeprefix(p) for p in PREFIXES])
    ]
    asked = spark.createDataFrame(forms, "position int, requested string, form int, id string")
    known = asked.join(available.select("id").distinct(), "id", "left_semi")
    first = known.groupBy("position", "requested").agg(F.min_by("id", "form").alias("id"))
    return (
        first.groupBy("id")
        .agg(F.min("position").alias("position"), F.min_by("requested", "position").alias("requested"))
        .select("position", "requested", "id")
    )
