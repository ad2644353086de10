"""Summaries over groups, families, annotations and dose tables.

Groups of results stay long tables (one row per member) wherever a group can grow
with the data; only bounded lists become arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshflux.functions.ordering import quantiles
from meshflux.session import cut

# Theme, its class, and the keywords that mark it.
THEMES = (
    ("chloride_anion_transport", ("chloride", "anion transport", "anion channel")),
    ("bicarbonate_transport", ("bicarbonate",)),
    ("water_transport", ("water transport", "aquaporin")),
    ("cell_volume_osmotic", ("osmotic", "cell volume", "cellular volume", "volume regulation")),
    ("ph_ion_homeostasis", ("ph homeostasis", "regulation of ph", "ion homeostasis", "proton transport")),
    ("membrane_transport", ("membrane transport", "transmembrane transport", "ion transport", "transporter activity", "channel activity")),
    ("calcium_handling", ("calcium ion", "calcium channel", "calcium release", "calcium homeostasis")),
    ("excitation_contraction", ("excitation-contraction", "excitation contraction", "cardiac muscle contraction")),
    ("sarcoplasmic_reticulum_calcium", ("sarcoplasmic reticulum", "junctional sarcoplasmic reticulum")),
    ("cholesterol_handling", ("cholesterol", "sterol")),
    ("lipoprotein_handling", ("lipoprotein", "low-density lipoprotein", "ldl receptor")),
)
BROAD_THEMES = ("membrane_transport",)
BROAD_FACTOR = 0.30


def complex_response(members: DataFrame, responses: DataFrame, targets: DataFrame, *, tolerance: float = 0.05) -> DataFrame:
    """Response of the complexes that hold a target: counts by sign, spread, coherence, balance.

    ``members(complex, id)``, ``responses(id, delta_pct)``. Members without a
    response count as unresolved, never as zero.
    """
    rows = members.select("complex", "id").distinct()
    wanted = rows.join(targets.select("id"), "id", "left_semi").groupBy("complex").agg(F.count(F.lit(1)).alias("perturbed"))
    joined = cut(rows.join(wanted, "complex").join(responses.select("id", "delta_pct"), "id", "left").withColumn("size", F.abs("delta_pct")))
    d = F.col("delta_pct")
    out = joined.groupBy("complex").agg(
        F.count(F.lit(1)).alias("members"), F.max("perturbed").alias("perturbed"), F.count(d).alias("responding"),
        F.count_if(d > tolerance).alias("positive"), F.count_if(d < -tolerance).alias("negative"), F.count_if(F.abs(d) <= tolerance).alias("low"),
        F.count_if(d.isNull()).alias("unresolved"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean_abs"),
        F.coalesce(F.max("size"), F.lit(0.0)).alias("max_abs"), F.sum(d).alias("_sum"), F.sum("size").alias("_all"))
    median = quantiles(joined, "size", {"median_abs": 0.5}, by=["complex"]).drop("n")
    ratio = lambda top: F.when(F.col("_all") > 0, top / F.col("_all")).otherwise(0.0)
    return out.join(median, "complex", "left").withColumns({
        "median_abs": F.coalesce("median_abs", F.lit(0.0)), "coherence": ratio(F.abs("_sum")), "balance": ratio(F.col("_sum"))}).drop("_sum", "_all")


def complex_label(responding: Column, coherence: Column, balance: Column) -> Column:
    return (
        F.when(responding == 0, "LOW RESPONSE / STABLE")
        .when((coherence >= 0.5) & (balance > 0), "COORDINATED POSITIVE REDISTRIBUTION")
        .when((coherence >= 0.5) & (balance < 0), "COORDINATED NEGATIVE REDISTRIBUTION").otherwise("MIXED REDISTRIBUTION"))


def compare_complexes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Labels of two engines per complex and whether they agree."""
    label = complex_label(F.col("responding"), F.col("coherence"), F.col("balance"))
    rows = left.select("complex", label.alias("left_label")).join(right.select("complex", label.alias("right_label")), "complex", "full_outer")
    a, b = F.col("left_label"), F.col("right_label")
    kind = (
        F.when(a.isNull() | b.isNull(), "MIXED / UNCERTAIN").when((a == b) & (a != "MIXED REDISTRIBUTION"), "CONSISTENT")
        .when(a != b, "DIRECTION-SENSITIVE").otherwise("MIXED / UNCERTAIN"))
    return rows.withColumn("cross_class", kind)


def group_metrics(members: DataFrame, candidates: DataFrame, neighbours: DataFrame, *, minimum: int = 2) -> DataFrame:
    """Metrics and amplification risk of groups with at least two candidates.

    ``members(group, id)``, ``candidates(id, delta_pct, importance, community)``.
    """
    best = candidates.orderBy(F.desc_nulls_last("delta_pct"), "id").limit(100).select("id", F.lit(1).alias("_top"))
    near = neighbours.select("id").distinct().withColumn("_near", F.lit(1))
    rows = cut(members.select("group", "id").distinct().join(candidates, "id").join(best, "id", "left").join(near, "id", "left"))
    sums = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("members"), (F.count("_top") / 100.0).alias("top_share"), F.avg("delta_pct").alias("mean_delta"),
        F.avg("importance").alias("mean_importance"), (F.count("_near") / F.count(F.lit(1))).alias("neighbour_share")).where(F.col("members") >= minimum)
    modal = rows.where("community IS NOT NULL").groupBy("group", "community").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max("n").alias("modal"))
    medians = quantiles(rows, "delta_pct", {"median_delta": 0.5}, by=["group"]).drop("n")
    out = sums.join(modal, "group", "left").join(medians, "group", "left")
    same = F.coalesce(F.col("modal") / F.col("members"), F.lit(0.0))
    risk = (
        F.when((F.col("members") >= 5) | (F.col("top_share") >= 0.15) | ((F.col("members") >= 3) & (same >= 0.8)), "high")
        .when((F.col("members") >= 3) | (F.col("top_share") >= 0.05), "medium").otherwise("low"))
    return out.withColumns({"community_share": same, "risk": risk}).drop("modal")


def themes(facts: DataFrame, *, rules: Sequence[tuple[str, Sequence[str]]] = THEMES, direction: str = "gain", minimum: int = 1) -> DataFrame:
    """Themes whose keywords occur in the annotation text of candidates, by priority.

    ``facts(symbol, text, delta_pct)``. Broad themes weigh less.
    """
    sign = -1.0 if direction == "loss" else 1.0
    size = F.greatest(F.lit(0.0), F.coalesce(F.col("delta_pct"), F.lit(0.0)) * F.lit(sign))
    text = F.lower("text")
    marks = F.array(*[
        F.struct(F.lit(name).alias("theme"), F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in words])).alias("words")) for name, words in rules])
    hits = facts.where("symbol IS NOT NULL AND symbol <> ''").select(F.upper("symbol").alias("symbol"), size.alias("size"), F.explode(marks).alias("m")).where(F.size("m.words") > 0)
    per = hits.select("m.theme", "symbol", "size", F.explode("m.words").alias("word"))
    genes = per.groupBy("theme", "symbol").agg(F.max("size").alias("size"))
    counted = genes.groupBy("theme").agg(F.count(F.lit(1)).alias("genes"), F.sum("size").alias("weight")).where(F.col("genes") >= minimum)
    words = per.groupBy("theme").agg(F.countDistinct("word").alias("keywords"))
    factor = F.when(F.col("theme").isin(*BROAD_THEMES), BROAD_FACTOR).otherwise(1.0)
    return counted.join(words, "theme").withColumns({
        "confidence": F.least(F.lit(0.95), F.lit(0.45) + F.lit(0.12) * F.col("genes") + F.lit(0.04) * F.col("keywords")),
        "priority": F.round(factor * (F.col("weight") + F.lit(0.08) * F.col("genes")), 6),
    }).orderBy(F.desc("priority"), F.desc("genes"), "theme")


def shared_annotations(annotations: DataFrame, responses: DataFrame, *, minimum: int = 2) -> tuple[DataFrame, DataFrame]:
    """Annotations that at least two responding entities share, and their members as rows."""
    rows = cut(annotations.select("kind", "term", "entity").distinct().join(responses.select("entity").distinct(), "entity", "left_semi"))
    sizes = rows.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= minimum)
    return sizes, rows.join(sizes.select("kind", "term"), ["kind", "term"], "left_semi")


def location_distribution(labels: DataFrame, responses: DataFrame) -> DataFrame:
    """Entities per location and their share of the annotated entities."""
    rows = cut(labels.where("location IS NOT NULL AND location <> 'Unknown'").select("entity", "location").distinct().join(
        responses.select("entity").distinct(), "entity", "left_semi"))
    total = rows.select("entity").distinct().agg(F.count(F.lit(1)).alias("total"))
    return rows.groupBy("location").agg(F.count(F.lit(1)).alias("entities")).join(F.broadcast(total)).select(  # one row
        "location", "entities", (F.col("entities") / F.col("total")).alias("share"))


def side_contrast(annotations: DataFrame, responses: DataFrame) -> DataFrame:
    """Per annotation: count and share among gains and among losses.

    ``responses(entity, direction)``.
    """
    sides = cut(responses.where("direction IN ('gain', 'loss')").select("entity", "direction").distinct())
    totals = sides.agg(F.count_if(F.col("direction") == "gain").alias("_g"), F.count_if(F.col("direction") == "loss").alias("_l"))
    rows = annotations.select("kind", "term", "entity").distinct().join(sides, "entity")
    counted = rows.groupBy("kind", "term").agg(
        F.count_if(F.col("direction") == "gain").alias("gains"), F.count_if(F.col("direction") == "loss").alias("losses"))
    return counted.join(F.broadcast(totals)).select(  # one row
        "kind", "term", "gains", "losses", F.try_divide(F.col("gains").cast("double"), F.col("_g")).alias("gain_share"),
        F.try_divide(F.col("losses").cast("double"), F.col("_l")).alias("loss_share"))


def gateway_overlap(rows: DataFrame) -> DataFrame:
    """Bottleneck entities per role, and how many of them are significant."""
    return rows.where("is_bottleneck").select("entity", "is_significant", F.explode("roles").alias("role")).groupBy("role").agg(
        F.countDistinct("entity").alias("entities"), F.countDistinct(F.when(F.col("is_significant"), F.col("entity"))).alias("significant"))


def assertions(targets: DataFrame, responses: DataFrame, annotations: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Shared annotations and direct relations between targets and responses, with a stable id.

    One equi-join of the few target annotations with the response annotations.
    ``annotations(entity, kind, term, source)``, ``relations(source, target, effect)``.
    """
    mine = annotations.join(targets.select("entity"), "entity", "left_semi").select(F.col("entity").alias("target"), "kind", "term", "source")
    theirs = annotations.join(responses.select("entity"), "entity", "left_semi").select(F.col("entity").alias("response"), "kind", "term")
    rows = mine.join(theirs, ["kind", "term"]).where("target <> response").select(
        "target", "response", F.concat(F.lit("shared_"), "kind").alias("type"), F.col("term").alias("detail"), F.col("source").alias("provenance"))
    if relations is not None:
        ts, rs = targets.select(F.col("entity").alias("target")), responses.select(F.col("entity").alias("response"))
        ahead = relations.select(F.col("source").alias("target"), F.col("target").alias("response"), F.concat(F.lit("target->response:"), "effect").alias("detail"))
        back = relations.select("target", F.col("source").alias("response"), F.concat(F.lit("response->target:"), "effect").alias("detail")).select(
            F.col("target"), "response", "detail")
        both = ahead.unionByName(back).join(ts, "target", "left_semi").join(rs, "response", "left_semi").where("target <> response")
        rows = rows.unionByName(both.select("target", "response", F.lit("directed_regulation").alias("type"), "detail", F.lit("regulators").alias("provenance")))
    rows = rows.distinct()
    return rows.withColumn("assertion_id", F.sha2(F.to_json(F.struct("target", "response", "type", "detail", "provenance")), 256))


def repeated_relationships(rows: DataFrame) -> DataFrame:
    """Assertion types that recur over several responses."""
    return rows.groupBy("target", "type").agg(F.countDistinct("response").alias("responses"), F.countDistinct("detail").alias("details")).where("responses >= 2")


def evidence_for(relations: DataFrame, symbols: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Directed-evidence rows between listed symbols, deduplicated; with ``limit`` the first in a fixed order."""
    ids = symbols.select("symbol").distinct()
    kept = relations.join(ids.withColumnRenamed("symbol", "source"), "source", "left_semi").join(ids.withColumnRenamed("symbol", "target"), "target", "left_semi")
    rows = kept.select("source", "target", "effect").distinct()
    return rows if limit is None else rows.orderBy("source", "target", "effect").limit(limit)


def candidate_facts(report: DataFrame, cache: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields from the report, else from the local cache, with the source of each."""
    joined = report.join(cache.select("id", *[F.col(f).alias(f"_{f}") for f in fields]), "id", "left")
    out = ["id"]
    for f in fields:
        own = F.col(f).isNotNull() & (F.col(f).cast("string") != "")
        out += [F.when(own, F.col(f)).otherwise(F.col(f"_{f}")).alias(f),
                F.when(own, "report").when(F.col(f"_{f}").isNotNull(), "cache").otherwise("missing").alias(f"{f}_source")]
    return joined.select(*out)


# --- dose tables -------------------------------------------------------------

EARLY_SHARE = 0.5
EARLY_SURVIVAL = 0.5
SUSPECT_SHARE = 0.5


def dose_findings(doses: DataFrame, half_loss: DataFrame, stressed: DataFrame) -> DataFrame:
    """Early compensation, recurring entities, insufficiency and the priority they add up to.

    ``doses(survival, boost)``, ``half_loss(half_loss_survival, status)``,
    ``stressed(survival, id)``.
    """
    top = doses.agg(F.max("boost").alias("max_boost"), F.count(F.lit(1)).alias("doses"))
    reached = doses.join(F.broadcast(top)).where((F.col("max_boost") > 0) & (F.col("boost") >= F.col("max_boost") * EARLY_SHARE))  # one row
    first = reached.agg(F.max("survival").alias("first_survival"))
    suspects = recurring_suspects(doses, stressed).agg(F.count(F.lit(1)).alias("suspects"))
    joined = top.join(first).join(suspects).join(half_loss)  # four one-row tables
    early = F.when(F.col("first_survival").isNull(), "none").when(F.col("first_survival") >= EARLY_SURVIVAL, "early").otherwise("late")
    lacking = F.when(F.col("status") == "resistant", "insufficient").when(F.col("half_loss_survival") > 0.5, "sensitive").otherwise("moderate")
    points = (early == "early").cast("int") + (F.col("suspects") >= 2).cast("int") + (lacking == "insufficient").cast("int")
    level = F.when(points >= 2, "high").when(points == 1, "medium").otherwise("low")
    return joined.select("max_boost", early.alias("compensation"), "suspects", lacking.alias("target_effect"), points.alias("points"), level.alias("priority"))


def recurring_suspects(doses: DataFrame, stressed: DataFrame) -> DataFrame:
    """Entities stressed in at least half of the doses."""
    total = doses.agg(F.count(F.lit(1)).alias("doses"))
    counts = stressed.select("survival", "id").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("seen"))
    return counts.join(F.broadcast(total)).where(F.col("seen") >= F.col("doses") * SUSPECT_SHARE).select("id", "seen", (F.col("seen") / F.col("doses")).alias("share"))  # one row
