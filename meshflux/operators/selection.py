"""Role rows, quotas, non-dominated layers, paging and engine comparison."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshflux.functions.inference import correlations
from meshflux.functions.measures import banded_sign
from meshflux.functions.ordering import quantiles, row_numbers
from meshflux.operators.scores import response_ranks
from meshflux.session import Lineage, cut
from meshflux.settings import COMPARE_TOP_N, MEANINGFUL_PCT, SENSITIVITY


def top_rows(df: DataFrame, order: Sequence, n: int, *, by: Sequence[str] = ()) -> DataFrame:
    """First n rows of a total order, overall or per group."""
    if not by:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_r") <= n).drop("_r")


def page(df: DataFrame, order: Sequence, *, number: int, size: int) -> DataFrame:
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def losses(responses: DataFrame, *, threshold_pct: float, limit: int) -> DataFrame:
    """Responses below ``-threshold_pct``, most negative first."""
    return responses.where(F.col("delta_pct") < -abs(threshold_pct)).orderBy("delta_pct", "id").limit(limit)


def union_keep_first(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of tables with different columns; for a repeated key the earliest table wins."""
    whole = None
    for place, frame in enumerate(frames):
        part = frame.withColumn("_source", F.lit(place))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    columns = [c for c in whole.columns if c not in (key, "_source")]
    best = whole.groupBy(key).agg(F.min_by(F.struct(*columns), F.col("_source")).alias("r"))
    return best.select(key, "r.*")


def role_matrix(targets: DataFrame, losing: DataFrame, gaining: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per id with its ordered roles and the first known value of each attribute."""
    tagged = None
    for place, (frame, role) in enumerate(((targets, "target"), (losing, "network_loss"), (gaining, "positive_response"))):
        part = frame.withColumns({"_place": F.lit(place), "_role": F.lit(role)})
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    known = [F.min_by(F.col(a), F.when(F.col(a).isNotNull(), F.col("_place"))).alias(a) for a in attributes]
    roles = F.transform(F.array_sort(F.collect_set(F.struct("_place", "_role"))), lambda x: x["_role"])
    return tagged.groupBy("id").agg(roles.alias("roles"), *known)


def assign_roles(rows: DataFrame, targets: DataFrame, *, mode: str) -> DataFrame:
    """Role list of each response row: target, positive_response, network_loss, fdr_supported.

    The FDR role exists only in ``null_fdr`` mode; rows without a role are dropped.
    """
    marked = rows.join(targets.select("id").distinct().withColumn("_t", F.lit(True)), "id", "left")
    target = F.col("_t").isNotNull()
    fdr = F.lit(mode == "null_fdr") & ~target & F.coalesce("is_significant", F.lit(False))
    roles = F.array_compact(F.array(
        F.when(target, "target"), F.when(~target & (F.col("direction") == "gain"), "positive_response"),
        F.when(fdr & (F.col("direction") == "loss"), "network_loss"), F.when(fdr, "fdr_supported")))
    return marked.withColumn("roles", roles).where(F.size("roles") > 0).drop("_t")


def quota_pick(buckets: DataFrame, *, budget: int) -> DataFrame:
    """Up to ``budget`` entities from ordered buckets, a quarter of it from each.

    ``buckets(bucket_order, bucket, position, entity)``; the first bucket has no
    quota. An entity keeps all reasons it was offered for.
    """
    share = max(1, budget // 4)
    order = Window.partitionBy("bucket_order").orderBy("position", "entity")
    offered = buckets.withColumn("_r", F.row_number().over(order)).where((F.col("bucket_order") == 0) | (F.col("_r") <= share))
    offered = cut(offered)
    first = offered.groupBy("entity").agg(
        F.min(F.struct("bucket_order", "_r")).alias("first"),
        F.transform(F.array_sort(F.collect_set(F.struct("bucket_order", "bucket"))), lambda x: x["bucket"]).alias("reasons"))
    return first.orderBy("first", "entity").limit(budget).select("entity", F.array_join("reasons", "; ").alias("reasons"))


def coalesce_requests(requests: DataFrame) -> DataFrame:
    """Requests with the same operation, taxon and text, with their lists merged."""
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return requests.groupBy("operation", "taxon", F.lower(F.trim("text")).alias("text")).agg(
        F.count(F.lit(1)).alias("merged"), merged("entities"), merged("reasons"))


# --- non-dominated layers ----------------------------------------------------

BLOCK_ROWS = 5_000


def _undominated(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Mask of ``rows`` that no row of ``others`` beats; larger is better."""
    keep = np.ones(len(rows), dtype=bool)
    for start in range(0, len(rows), 256):
        part = rows[start:start + 256]
        ge = (others[None, :, :] >= part[:, None, :]).all(axis=2)
        gt = (others[None, :, :] > part[:, None, :]).any(axis=2)
        keep[start:start + 256] = ~(ge & gt).any(axis=1)
    return keep


def _all_layers(lineage: Lineage, vectors: DataFrame, names: Sequence[str], block_rows: int) -> DataFrame:
    """Layer of every distinct vector, block by block in falling order.

    A vector is beaten only by those before it, so a block is settled once all
    blocks before it have raised its layers: one round a block, in which one task
    settles it and then each later block meets it in a task of its own.
    """
    whole = F.lit(True)
    for c in names:
        whole &= F.col(c).isNotNull() & ~F.isnan(c)
    done = vectors.where(~whole).select(*names, F.lit(1).cast("long").alias("layer"))
    placed = row_numbers(vectors.where(whole).select(*names), [F.desc(c) for c in names], name="_row")
    left = lineage.cut(placed.select(*names, F.lit(1).cast("long").alias("layer"), F.floor((F.col("_row") - 1) / block_rows).cast("int").alias("_block")))

    def settle(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(list(names), ascending=False)
        values, layer = block[names].to_numpy(float), block["layer"].to_numpy().copy()
        for k in range(1, len(layer)):
            over = (values[:k] >= values[k]).all(axis=1)
            if over.any():
                layer[k] = max(layer[k], layer[:k][over].max() + 1)
        return block.assign(layer=layer)

    def lift(block: pd.DataFrame, settled: pd.DataFrame) -> pd.DataFrame:
        values, others, over = block[names].to_numpy(float), settled[names].to_numpy(float), settled["layer"].to_numpy()
        layer = block["layer"].to_numpy().copy()
        for start in range(0, len(values), 256):
            ge = (others[None, :, :] >= values[start:start + 256, None, :]).all(axis=2)
            layer[start:start + 256] = np.maximum(layer[start:start + 256], np.where(ge, over[None, :] + 1, 1).max(axis=1))
        return block.assign(layer=layer)

    last = left.agg(F.max("_block")).first()[0]
    for at in range(0 if last is None else last + 1):
        settled = lineage.cut(left.where(F.col("_block") == at).groupBy("_block").applyInPandas(settle, left.schema))
        done = done.unionByName(settled.drop("_block"))
        if at < last:
            sent = settled.drop("_block").withColumn("_block", F.explode(F.sequence(F.lit(at + 1), F.lit(last))))
            after = left.where(F.col("_block") > at).groupBy("_block").cogroup(sent.groupBy("_block"))
            after = lineage.cut(after.applyInPandas(lift, left.schema))
            lineage.drop(left)
            left = after
    return done


def pareto_layers(rows: DataFrame, objectives: Sequence[str], *, limit: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Non-dominated layer of each row, layer 1 first; larger objectives are better.

    Equal objective vectors share a layer, so only distinct vectors are compared.
    All layers take one round for each block of vectors. With ``limit`` they are
    taken off one by one, and stop once that many rows are placed: each partition
    first drops what it can decide alone; the survivors are cut into blocks of
    bounded size and compared block against block, each pair of blocks in its own
    task. A row with a missing objective is in layer 1 and beats no other.
    """
    lineage = Lineage(rows.sparkSession)
    names = list(objectives)
    base = lineage.cut(rows.select("id", *[F.col(c).cast("double").alias(c) for c in names]))
    left = lineage.cut(base.groupBy(*names).agg(F.count(F.lit(1)).alias("members")))
    if limit is None:
        layers = _all_layers(lineage, left, names, block_rows).withColumnsRenamed({c: f"_{c}" for c in names})
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
        return base.join(layers, functools.reduce(operator.and_, same)).select("id", "layer", *names)
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in names])
    layers, placed, layer = None, 0, 1

    def local(batches):
        best = np.empty((0, len(names)))
        for batch in batches:
            both = np.vstack([best, batch[names].to_numpy(float)])
            best = both[_undominated(both, both)]
        yield pd.DataFrame(best, columns=names)

    def against(group: pd.DataFrame) -> pd.DataFrame:
        mine = group.loc[~group["_other"], names].to_numpy(float)
        theirs = group.loc[group["_other"], names].to_numpy(float)
        kept = mine[_undominated(mine, theirs)] if len(mine) and len(theirs) else mine
        return pd.DataFrame(kept, columns=names)

    while not left.isEmpty():
        some = lineage.cut(left.select(*names).mapInPandas(local, schema))
        size = some.count()
        blocks = max(1, math.ceil(size / block_rows))
        placed_in = some.withColumn("_block", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int"))
        every = F.sequence(F.lit(0), F.lit(blocks - 1))
        mine = placed_in.select(*names, F.col("_block").alias("_a"), F.explode(every).alias("_b"), F.lit(False).alias("_other"))
        theirs = placed_in.select(*names, F.explode(every).alias("_a"), F.col("_block").alias("_b"), F.lit(True).alias("_other"))
        won = mine.unionByName(theirs).groupBy("_a", "_b").applyInPandas(against, schema)
        front = lineage.cut(won.groupBy(*names).agg(F.count(F.lit(1)).alias("wins")).where(F.col("wins") == blocks).select(*names))
        part = front.withColumn("layer", F.lit(layer))
        layers = part if layers is None else layers.unionByName(part)
        placed += left.join(front, names, "left_semi").agg(F.sum("members")).first()[0]
        after = lineage.cut(left.join(front, names, "left_anti"))
        lineage.drop(left)
        left, layer = after, layer + 1
        if limit is not None and placed >= limit:
            break
    return base.join(layers, names).select("id", "layer", *names)


def candidate_search(
    edges: DataFrame, scores: DataFrame, target: str, regulators: DataFrame, *, limit: int, direct_only: bool = False
) -> DataFrame:
    """Candidates that may move a target, in non-dominated layers.

    Neighbours, regulators, and all nodes of the target's community, rated by
    distance, PageRank, betweenness, importance and being a bottleneck.
    ``scores(id, pagerank, betweenness, importance, is_bottleneck, community)``.
    """
    from meshflux.operators.propagation import symmetric_arcs
    from meshflux.operators.traversal import shortest_distances, vertices_of

    spark = edges.sparkSession
    arcs = cut(symmetric_arcs(edges, "distance"))
    nodes = vertices_of(arcs)
    near = arcs.where(F.col("src") == target).select(F.col("dst").alias("id")).withColumn("is_neighbour", F.lit(True))
    direct = regulators.where(F.col("target") == target).select(F.col("regulator").alias("id"), "effect").groupBy("id").agg(F.min("effect").alias("effect"))
    own = scores.where(F.col("id") == target).select("community")
    same = scores.join(own, "community", "left_semi").select("id")
    ids = near.select("id").unionByName(direct.select("id")).unionByName(same).distinct().where(F.col("id") != target).join(nodes, "id", "left_semi")
    origin = spark.createDataFrame([(target,)], "source string")
    distance = shortest_distances(arcs, origin).select("id", "dist")
    rows = ids.join(distance, "id", "left").join(scores, "id", "left").join(near.distinct(), "id", "left").join(direct, "id", "left")
    if direct_only:
        rows = rows.where("effect IS NOT NULL")
    rows = cut(rows.select(
        "id", (-F.coalesce("dist", F.lit(999999.0))).alias("nearness"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("pagerank", "betweenness", "importance")],
        F.coalesce("is_bottleneck", F.lit(False)).cast("double").alias("gate"), F.coalesce("is_neighbour", F.lit(False)).alias("is_neighbour"), "effect"))
    layered = pareto_layers(rows, ["nearness", "pagerank", "betweenness", "importance", "gate"], limit=limit).select("id", "layer")
    return rows.join(layered, "id").orderBy("layer", F.desc("nearness"), F.desc("importance"), F.desc("betweenness"), "id").limit(limit)


def validate_candidates(arcs: DataFrame, candidates: DataFrame, observed: str, *, factor: float, damping: float = 0.85) -> DataFrame:
    """Effect of each candidate's attenuation on one observed node, strongest first; all in one batched run."""
    from meshflux.plans.scenarios import system_shift, what_if

    table = cut(candidates.select(F.col("id").alias("scenario_id"), "id", F.lit(float(factor)).alias("factor")))
    responses = cut(what_if(arcs, table, damping=damping))
    seen = responses.where(F.col("id") == observed).select("scenario_id", "delta_pct", "direction")
    return seen.join(system_shift(responses), "scenario_id").select(
        F.col("scenario_id").alias("id"), "delta_pct", F.abs("delta_pct").alias("effect"), "system_shift_pct", (F.col("direction") == "gain").alias("target_responds")
    ).orderBy(F.desc("effect"), "id")


def betweenness_change(edges: DataFrame, candidates: Sequence[str], observed: str, *, factor: float, sample: int | None = None, hops: int | None = 2) -> DataFrame:
    """Change of the observed node's betweenness per attenuated candidate.

    With ``hops`` the betweenness is that of the observed node's neighbourhood,
    otherwise of the whole graph.
    """
    from meshflux.operators.centrality import betweenness
    from meshflux.operators.propagation import symmetric_arcs
    from meshflux.operators.traversal import induced_subgraph, neighbourhood
    from meshflux.plans.scenarios import scenario_arcs, scenario_table

    spark = edges.sparkSession
    graph = edges.select("src", "dst", "weight")
    if hops is not None:
        origin = spark.createDataFrame([(observed,)], "id string")
        graph = induced_subgraph(graph, neighbourhood(symmetric_arcs(graph), origin, hops=hops))
    arcs = cut(symmetric_arcs(graph))
    table = scenario_table(spark, {c: [c] for c in candidates}, factor)
    rated = cut(betweenness(scenario_arcs(arcs, table), sample=sample, by=["scenario_id"]).where(F.col("id") == observed))
    base = rated.where("scenario_id = 'base'").select(F.col("betweenness").alias("before"))
    return rated.where("scenario_id <> 'base'").join(F.broadcast(base)).select(  # one row
        F.col("scenario_id").alias("id"), "before", F.col("betweenness").alias("after"), (F.col("betweenness") - F.col("before")).alias("change"))


# --- comparing two engines ---------------------------------------------------

def require_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    if not df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{what} holds duplicate ids")
    return df


def compare_outer(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer comparison of two response tables; a missing response stays null."""
    a = require_unique(left, "id", "left table").select("id", F.col("delta_pct").alias("left_response"), F.lit(True).alias("_l"))
    b = require_unique(right, "id", "right table").select("id", F.col("delta_pct").alias("right_response"), F.lit(True).alias("_r"))
    where = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return a.join(b, "id", "full_outer").select(
        "id", "left_response", "right_response", where.alias("found_in"), (F.col("right_response") - F.col("left_response")).alias("difference"))


def ordered_by_gap(compared: DataFrame) -> DataFrame:
    return compared.orderBy(F.abs("difference").desc_nulls_last(), "id")


def compare_complete(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner comparison that refuses tables that do not cover the same ids, or hold nulls."""
    rows = cut(compare_outer(left, right))
    lacking = rows.agg(F.count_if(F.col("left_response").isNull()).alias("l"), F.count_if(F.col("right_response").isNull()).alias("r")).first()
    if lacking["l"] or lacking["r"]:
        raise ValueError(f"comparison incomplete: missing left {lacking['l']}, missing right {lacking['r']}")
    a = response_ranks(rows.select("id", F.col("left_response").alias("delta_pct"))).select("id", F.col("absolute_rank").alias("left_rank"))
    b = response_ranks(rows.select("id", F.col("right_response").alias("delta_pct"))).select("id", F.col("absolute_rank").alias("right_rank"))
    return rows.drop("found_in").join(a, "id").join(b, "id").withColumn("rank_shift", F.col("left_rank") - F.col("right_rank"))


def comparison_summary(compared: DataFrame, *, ks: Sequence[int] = (50, 100, 300)) -> DataFrame:
    """Correlations, overlap and Jaccard at k, and rank shifts of a complete comparison."""
    rows = cut(compared.withColumns({"shift": F.abs("rank_shift").cast("double")}))
    size = rows.count()
    counts = []
    for k in ks:
        n = min(k, size)
        counts.append((k, n))
    rho = correlations(rows, "left_rank", "right_rank", minimum=2).select("n", F.col("spearman").alias("rank_spearman"))
    pearson = correlations(rows, "left_response", "right_response", minimum=2).select("pearson")
    out = rho.join(F.broadcast(pearson))  # one-row tables throughout
    for k, n in counts:
        first = rows.orderBy("left_rank", "id").limit(n).select("id")
        second = rows.orderBy("right_rank", "id").limit(n).select("id")
        both = first.join(second, "id", "left_semi").agg(F.count(F.lit(1)).alias(f"overlap_at_{k}"))
        out = out.join(F.broadcast(both)).withColumn(f"jaccard_at_{k}", F.col(f"overlap_at_{k}") / (F.lit(2 * n) - F.col(f"overlap_at_{k}")))
    shift = quantiles(rows, "shift", {"median_shift": 0.5}).drop("n")
    return out.join(F.broadcast(shift)).join(F.broadcast(rows.agg(F.avg("shift").alias("mean_shift"))))


def synthesize(left: DataFrame, right: DataFrame, *, top_n: int = COMPARE_TOP_N, threshold: float = MEANINGFUL_PCT, sensitivity: float = SENSITIVITY) -> DataFrame:
    """Findings of two engines side by side with a class per entity; missing is never zero."""
    def side(df, name):
        ranks = response_ranks(df.where("delta_pct IS NOT NULL").select("id", "delta_pct"))
        return ranks.select("id", F.col("delta_pct").alias(f"{name}_response"), banded_sign("delta_pct", threshold).alias(f"{name}_sign"),
                            F.col("absolute_rank").alias(f"{name}_rank"), F.col("absolute_rank_percentile").alias(f"{name}_percentile"))

    rows = side(require_unique(left, "id", "left table"), "left").join(side(require_unique(right, "id", "right table"), "right"), "id", "full_outer")
    has_l, has_r = F.col("left_response").isNotNull(), F.col("right_response").isNotNull()
    both = has_l & has_r
    same = both & (F.col("left_sign") == F.col("right_sign"))
    loud = lambda c: F.col(c).isin("POSITIVE", "NEGATIVE")
    flip = both & loud("left_sign") & loud("right_sign") & ~same
    gap = F.abs(F.col("right_percentile") - F.col("left_percentile"))
    up_l, up_r = F.coalesce(F.col("left_rank") <= top_n, F.lit(False)), F.coalesce(F.col("right_rank") <= top_n, F.lit(False))
    robust = both & same & up_l & up_r
    kind = (
        F.when(robust, "ROBUST_CROSS_MODEL").when(both & (flip | (gap >= sensitivity)), "DIRECTION_SENSITIVE")
        .when(both & up_l & ~up_r, "LEFT_DOMINANT").when(both & up_r & ~up_l, "RIGHT_EMERGENT")
        .when(has_l & ~has_r, "LEFT_ONLY").when(has_r & ~has_l, "RIGHT_ONLY").otherwise("LOW_AGREEMENT"))
    return rows.withColumns({"same_sign": F.coalesce(same, F.lit(False)), "sign_flip": F.coalesce(flip, F.lit(False)), "sensitivity": gap, "finding": kind})


def presentation(responses: DataFrame, targets: DataFrame, *, minimum_pct: float = 0.05, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Report rows (targets, then the best gains), all losses, and a one-row summary."""
    gains = responses.where(F.col("delta_pct") > minimum_pct)
    best = gains.orderBy(F.desc("delta_pct"), "id").limit(limit).withColumn("role", F.lit("responder"))
    report = targets.withColumn("role", F.lit("target")).unionByName(best, allowMissingColumns=True)
    lost = responses.where(F.col("delta_pct") < -minimum_pct)
    summary = responses.agg(
        F.count_if(F.col("delta_pct") > minimum_pct).alias("positive"), F.count_if(F.col("delta_pct") < -minimum_pct).alias("negative"),
        F.max("delta_pct").alias("strongest_gain"), F.min("delta_pct").alias("strongest_loss"))
    return report, lost, summary


def side_balance(gain_terms: DataFrame, loss_terms: DataFrame) -> DataFrame:
    """Themes on both sides, or on one side only."""
    a = gain_terms.select("theme").distinct().withColumn("_g", F.lit(True))
    b = loss_terms.select("theme").distinct().withColumn("_l", F.lit(True))
    side = F.when(F.col("_g") & F.col("_l"), "both").when(F.col("_g"), "gains").otherwise("losses")
    return a.join(b, "theme", "full_outer").select("theme", side.alias("side"))


def component_sides(components: DataFrame, gaining: DataFrame, losing: DataFrame) -> DataFrame:
    """Side of each canonical component: gains, losses, or outside."""
    g = gaining.select("symbol").distinct().withColumn("_g", F.lit("gains"))
    lo = losing.select("symbol").distinct().withColumn("_l", F.lit("losses"))
    return components.join(g, "symbol", "left").join(lo, "symbol", "left").select("symbol", F.coalesce("_g", "_l", F.lit("outside")).alias("side"))


def independent_support(candidates: DataFrame, memberships: DataFrame, *, limit: int = 5) -> DataFrame:
    """Representatives per theme in order, never two of one group.

    ``candidates(theme, position, id)``, ``memberships(group, id)``. A greedy
    choice only ever needs the first few of an order, and a group that blocks a
    candidate was itself represented earlier; each round takes the first open
    candidate of every theme and drops what it blocks.
    """
    lineage = Lineage(candidates.sparkSession)
    groups = lineage.cut(memberships.select("group", "id").distinct())
    left = lineage.cut(candidates.select("theme", "position", "id").groupBy("theme", "id").agg(F.min("position").alias("position")))
    chosen = None
    for turn in range(limit):
        best = lineage.cut(left.groupBy("theme").agg(F.min(F.struct("position", "id")).alias("b")).select(
            "theme", F.col("b.position").alias("position"), F.col("b.id").alias("id"), F.lit(turn + 1).alias("place")))
        if best.isEmpty():
            break
        chosen = best if chosen is None else chosen.unionByName(best)
        used = best.join(groups, "id").select("theme", "group").distinct()
        blocked = left.join(groups, "id").join(used, ["theme", "group"], "left_semi").select("theme", "id").distinct()
        left = lineage.cut(left.join(blocked, ["theme", "id"], "left_anti").join(best.select("theme", "id"), ["theme", "id"], "left_anti"))
    return chosen
