"""Comparisons across two datasets linked by a mapping of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshflux.functions.inference import correlations
from meshflux.functions.ordering import row_numbers
from meshflux.session import cut

# Mapping type in the source and its class.
CLASSES = {"ortholog_one2one": "ONE_TO_ONE", "ortholog_one2many": "ONE_TO_MANY", "ortholog_many2many": "MANY_TO_MANY"}


def classify_mapping(rows: DataFrame) -> DataFrame:
    """Class of each mapping row; a symbol with several partners is never one-to-one.

    ``rows(symbol, partner, kind, confidence)``. Partner counts come from distinct
    (symbol, partner) pairs, so a symbol with very many rows is not collected.
    """
    clean = rows.select(
        F.trim("symbol").alias("symbol"), F.when(F.trim("partner") != "", F.trim("partner")).alias("partner"), "kind",
        F.expr("try_cast(confidence AS double)").cast("int").alias("confidence")).where("symbol IS NOT NULL AND symbol <> ''")
    base = F.when(F.col("partner").isNull(), "NO_ORTHOLOG")
    for raw, name in CLASSES.items():
        base = base.when(F.col("kind") == raw, name)
    base = base.otherwise("UNRESOLVED")
    partners = clean.where("partner IS NOT NULL").select(F.lower("symbol").alias("_k"), "partner").distinct().groupBy("_k").agg(F.count(F.lit(1)).alias("partners"))
    joined = clean.withColumn("_k", F.lower("symbol")).join(partners, "_k", "left")
    several = F.coalesce("partners", F.lit(0)) > 1
    adjusted = F.when(several & (base != "MANY_TO_MANY"), "ONE_TO_MANY").otherwise(base)
    return joined.select("symbol", "partner", adjusted.alias("class"), "confidence")


def class_counts(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("class").agg(F.countDistinct(F.lower("symbol")).alias("symbols"))


def ranked_responses(rows: DataFrame) -> DataFrame:
    """Rank by size of response, keeping the strongest row per symbol: ``raw_rank, rank_share``."""
    usable = rows.where("symbol IS NOT NULL AND delta_pct IS NOT NULL AND NOT isnan(delta_pct)")
    best = usable.groupBy("symbol").agg(F.max_by("delta_pct", F.struct(F.abs("delta_pct"), "delta_pct")).alias("delta_pct"))
    placed = row_numbers(best.withColumn("_size", F.abs("delta_pct")), [F.desc("_size"), F.asc("symbol")], name="raw_rank").drop("_size")
    total = best.agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(F.broadcast(total)).withColumn("rank_share", F.col("raw_rank") / F.col("_n")).drop("_n")  # one row


def bijective(mapping: DataFrame) -> DataFrame:
    """One-to-one pairs whose partner is named by exactly one symbol."""
    pairs = mapping.where(F.col("class") == "ONE_TO_ONE").select("symbol", "partner").distinct()
    once = pairs.groupBy("partner").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("partner")
    return pairs.join(once, "partner", "left_semi").select("symbol", "partner")


def compare_mapped(first: DataFrame, second: DataFrame, mapping: DataFrame) -> DataFrame:
    """Responses of one-to-one partners side by side, with the consistency of direction."""
    a = ranked_responses(first).select("symbol", F.col("delta_pct").alias("first_response"), F.col("rank_share").alias("first_share"), F.col("raw_rank").alias("first_rank"))
    b = ranked_responses(second).select(F.col("symbol").alias("partner"), F.col("delta_pct").alias("second_response"), F.col("rank_share").alias("second_share"), F.col("raw_rank").alias("second_rank"))
    joined = a.join(bijective(mapping), "symbol").join(b, "partner")
    x, y = F.col("first_response"), F.col("second_response")
    kind = (
        F.when((x > 0) & (y > 0), "CONCORDANT_POSITIVE").when((x < 0) & (y < 0), "CONCORDANT_NEGATIVE")
        .when(F.signum(x) != F.signum(y), "DISCORDANT").otherwise("SPECIES_SPECIFIC_OR_ZERO"))
    return joined.withColumn("consistency", kind)


def comparison_metrics(matched: DataFrame, *, ks: Sequence[int] = (20, 50, 100)) -> DataFrame:
    """Counts by consistency, concordance rate, rank correlation and top overlaps."""
    matched = cut(matched)
    c = F.col("consistency")
    out = matched.agg(
        F.count(F.lit(1)).alias("comparable"), F.count_if(c == "CONCORDANT_POSITIVE").alias("concordant_positive"),
        F.count_if(c == "CONCORDANT_NEGATIVE").alias("concordant_negative"), F.count_if(c == "DISCORDANT").alias("discordant"),
        F.avg(c.startswith("CONCORDANT").cast("double")).alias("concordance"),
        *[F.count_if((F.col("first_rank") <= k) & (F.col("second_rank") <= k)).alias(f"top_{k}_overlap") for k in ks])
    rho = correlations(matched, "first_share", "second_share", minimum=2).select("spearman")
    return out.join(F.broadcast(rho))  # one-row tables


def resolve_partner(queries: DataFrame, symbols: DataFrame, mapping: DataFrame, *, foreign: str = r"^ENSP\d+") -> DataFrame:
    """Second-dataset id of a query: exact id, exact symbol, or a one-to-one alias.

    ``symbols(symbol, id)``. An id of the other dataset is rejected.
    """
    asked = queries.select("query", F.lower(F.trim("query")).alias("k")).distinct()
    ids = symbols.select(F.lower("id").alias("k"), F.col("id").alias("by_id")).distinct()
    named = symbols.groupBy(F.lower("symbol").alias("k")).agg(F.min("id").alias("by_symbol"))
    linked = bijective(mapping).select(F.lower("symbol").alias("k"), F.lower("partner").alias("_p")).join(
        named.select(F.col("k").alias("_p"), F.col("by_symbol").alias("by_alias")), "_p").select("k", "by_alias")
    rows = asked.join(ids, "k", "left").join(named, "k", "left").join(linked, "k", "left")
    wrong = F.col("query").rlike(foreign)
    status = F.when(wrong, "WRONG_SPECIES").when(F.col("by_id").isNotNull(), "EXACT_ID").when(F.col("by_symbol").isNotNull(), "EXACT_SYMBOL").when(
        F.col("by_alias").isNotNull(), "ORTHOLOG_ALIAS").otherwise("UNRESOLVED")
    return rows.select("query", status.alias("status"), F.when(~wrong, F.coalesce("by_id", "by_symbol", "by_alias")).alias("id"))


def suitability(queries: DataFrame, mapping: DataFrame, symbols: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Whether a symbol has one usable partner in the other graph and context.

    ``nodes(id)`` are the graph, ``members(id)`` the context.
    """
    per = mapping.groupBy(F.lower("symbol").alias("k")).agg(
        F.countDistinct("partner").alias("partners"), F.min("partner").alias("partner"),
        F.bool_or(F.col("class").isin("ONE_TO_MANY", "MANY_TO_MANY") & F.col("partner").isNotNull()).alias("several"))
    ids = symbols.groupBy(F.lower("symbol").alias("_p")).agg(F.min("id").alias("id"))
    rows = queries.select("query", F.lower("query").alias("k")).distinct().join(per, "k", "left").withColumn("_p", F.lower("partner")).join(ids, "_p", "left")
    rows = rows.join(nodes.select("id").distinct().withColumn("_g", F.lit(True)), "id", "left").join(members.select("id").distinct().withColumn("_c", F.lit(True)), "id", "left")
    status = (
        F.when(F.col("partners").isNull(), "UNRESOLVED").when(F.col("partners") == 0, "NO_DIRECT_ORTHOLOG")
        .when((F.col("partners") > 1) | F.col("several"), "MULTIPLE_ORTHOLOGS")
        .when(F.col("id").isNull() | F.col("_g").isNull(), "ORTHOLOG_EXISTS_NOT_IN_GRAPH")
        .when(F.col("_c").isNull(), "ORTHOLOG_EXISTS_CONTEXT_UNAVAILABLE").otherwise("DIRECT_ORTHOLOG_AVAILABLE"))
    return rows.select("query", status.alias("status"), "partner")


def proxies(target: DataFrame, others: DataFrame, *, limit: int = 10) -> DataFrame:
    """Items of the other dataset that share most annotations with one target.

    Long tables ``(kind, term)`` and ``(id, kind, term, supported)``; the order is
    family, pathways, functions, processes, compartments, support, then id.
    """
    mine = target.select("kind", "term").distinct()
    shared = others.select("id", "kind", "term").distinct().join(mine, ["kind", "term"], "left_semi")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    rows = shared.groupBy("id").agg(
        (count("family") > 0).cast("int").alias("same_family"), count("pathway").alias("pathways"), count("function").alias("functions"),
        count("process").alias("processes"), count("compartment").alias("compartments"))
    helped = others.groupBy("id").agg(F.bool_or("supported").cast("int").alias("supported"))
    every = helped.join(rows, "id", "left").fillna(0)
    names = ["same_family", "pathways", "functions", "processes", "compartments", "supported"]
    total = F.lit(0)
    for n in names:
        total = total + F.col(n)
    return every.withColumn("evidence", total).where("evidence > 0").orderBy(*[F.desc(n) for n in names], F.desc("id")).limit(limit)


def essentiality_validation(scores: DataFrame, screens: DataFrame, *, minimum_tests: int = 3) -> DataFrame:
    """Rank correlation of importance with the hit ratio of tested symbols.

    ``screens(symbol, hits, tests)``. Fewer than 20 symbols are insufficient.
    """
    usable = screens.where(F.col("tests") >= minimum_tests).select("symbol", (F.col("hits") / F.col("tests")).alias("hit_ratio"))
    rho = correlations(scores.join(usable, "symbol"), "importance", "hit_ratio", minimum=20)
    return rho.select("n", "spearman", F.when(F.col("n") < 20, "INSUFFICIENT").otherwise("COMPLETED").alias("status"))
