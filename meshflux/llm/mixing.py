"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded block selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshflux.llm.common import Lineage, attach, whole_text

#: Words are separated by space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Tokens of a block.
BLOCK = 32
#: Rows of a shard, and shards of a bin, on average.
ROWS_PER_SHARD = 4096
SHARDS_PER_BIN = 512
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = 20240229
#: Larger than the number of blocks of a shard, and prime: a multiplier that reorders them.
_PRIME = 2_147_483_647


def targets(sizes: pd.Series, weights: pd.Series, share: float, repeats: float) -> pd.Series:
    """Weighted shares of ``share`` times all sizes, stopped at ``repeats`` times a size, the excess reshared by weight."""
    rest = share * float(sizes.sum())
    out = pd.Series(0.0, index=sizes.index)
    free = sizes > 0
    out[~free] = 0.0
    while free.any():
        part = rest * weights[free] / weights[free].sum()
        over = part > repeats * sizes[free]
        if not over.any():
            out[part.index] = part
            break
        stopped = over.index[over]
        out[stopped] = repeats * sizes[stopped].astype(float)
        rest = max(0.0, rest - float(out[stopped].sum()))
        free[stopped] = False
    return out


def sainte_lague(claims: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients claim / (2 s + 1), at most ``caps`` each; ties to the earlier row.

    A divisor that gives about the right number is bisected first, then single
    seats follow by their quotients, so the work does not grow with the seats.
    """
    claims = np.asarray(claims, float)
    caps = np.asarray(caps, np.int64)
    caps = np.where(claims > 0, caps, 0)
    seats = min(int(seats), int(caps.sum()))
    if seats <= 0:
        return np.zeros(len(claims), np.int64)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(caps, np.floor(np.minimum(claims / divisor + 0.5, 2.0**62)).astype(np.int64))

    low, high = 0.0, 2.0 * claims.max() + 1.0  # too small a divisor gives too many seats
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if given(middle).sum() > seats:
            low = middle
        else:
            high = middle
    out = given(high)
    while (missing := seats - int(out.sum())) > 0:
        quotients = np.where(out < caps, claims / (2.0 * out + 1.0), -1.0)
        out[np.argsort(-quotients, kind="stable")[: min(missing, int((out < caps).sum()), 1)]] += 1
    return out


def _shares(weights: tuple, share: float, repeats: int, block: int):
    def run(sources: pd.DataFrame) -> pd.DataFrame:
        # The key sorts by code point with null last.
        sources = sources.sort_values("key", kind="stable").reset_index(drop=True)
        weigh = pd.Series([float(weights[i % len(weights)]) for i in range(len(sources))])
        aim = targets(sources["source_size"], weigh, share, repeats)
        caps = -(-repeats * sources["source_size"] // block)
        seats = sainte_lague(aim.to_numpy(), caps.to_numpy(), int(aim.sum() / block + 0.5))
        return pd.DataFrame({"key": sources["key"], "source_size": sources["source_size"], "target": aim, "quota": seats})

    return run


def _split(group: pd.DataFrame) -> pd.DataFrame:
    """Deal the quota of a parent to its children by their tokens."""
    group = group.sort_values("child")
    seats = sainte_lague(group["tokens"].to_numpy(), group["cap"].to_numpy(), int(group["quota"].iloc[0]))
    return pd.DataFrame({"key": group["key"], "child": group["child"], "quota": seats})


def source_key(source: Column) -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def mix(
    spark: SparkSession, rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each row of ``rows`` (doc_id, text, source) a mix takes.

    Sources in order of code point (null last) weigh ``weights`` in turn and
    share ``share`` times all words; no target exceeds ``repeats`` times its
    source, the excess is shared anew by weight. The targets become whole
    blocks of ``block`` words by Sainte-Lague, source first, then the bins and
    shards of a source by their words. A shard is a seeded hash of rows, its
    words a stream in seeded order, cut into blocks; it takes all blocks as
    often as its quota allows and the rest of the quota as a seeded selection.
    ``taken`` counts the words of a row in taken blocks, so it never exceeds
    ``repeats`` times its size. A source is met to half a block and the short
    last blocks of its shards.

    Null texts have no words, as have empty ones: taken is 0. A null source is
    a source of its own. Rows that repeat count each. An empty table gives an
    empty result. Other columns are ignored.

    Columns: keys, doc_id, size, source, source_size, target, taken, shard (key
    of the source and number), place (the seeded order in it).
    """
    lineage = Lineage(spark)
    sized = lineage.cut(rows.select(
        *keys, "doc_id", "source", source_key(F.col("source")).alias("key"), F.xxhash64(whole_text()).alias("digest"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"))
        .withColumn("place", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("digest"))))
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = lineage.cut(sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("n") / ROWS_PER_SHARD)).cast("long")))
    # One row a source here.
    aims = lineage.cut(sources.groupBy(F.lit(1).alias("all")).applyInPandas(
        _shares(weights, share, repeats, block), "key string, source_size long, target double, quota long"))

    dealt = attach(sized, sources.select("key", "shards"), ["key"])
    dealt = lineage.cut(dealt.withColumn("shard", F.pmod(F.xxhash64("place"), F.col("shards"))).drop("shards"))
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("tokens")).withColumns({
        "cap": F.lit(repeats) * F.ceil(F.col("tokens") / block), "bin": F.floor(F.col("shard") / SHARDS_PER_BIN).cast("long")})
    shards = lineage.cut(shards)
    bins = shards.groupBy("key", "bin").agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap"))
    schema = "key string, child long, quota long"
    bins = attach(bins.withColumnRenamed("bin", "child"), aims.select("key", "quota"), ["key"]).groupBy("key").applyInPandas(_split, schema)
    bins = lineage.cut(bins.select("key", F.col("child").alias("bin"), "quota"))
    quotas = attach(shards.withColumnRenamed("shard", "child"), bins, ["key", "bin"]).groupBy("key", "bin").applyInPandas(_split, schema)
    quotas = quotas.select("key", F.col("child").alias("shard"), "quota").join(shards.select("key", "shard", "tokens"), ["key", "shard"])
    quotas = lineage.cut(quotas.withColumn("blocks", F.ceil(F.col("tokens") / block)))

    lineage.release(dealt, quotas, aims)
    stream = Window.partitionBy("key", "shard").orderBy("place", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    laid = attach(dealt.withColumn("stop", F.sum("size").over(stream)), quotas, ["key", "shard"])
    laid = attach(laid, aims.select("key", "source_size", "target"), ["key"])
    start = F.col("stop") - F.col("size")
    # blocks is null-free but zero for a shard without words, whose rows take nothing.
    blocks = F.greatest(F.col("blocks"), F.lit(1))
    rest = F.pmod(F.col("quota"), blocks)
    step = F.pmod(F.lit(_PRIME), blocks)
    turn = F.pmod(F.xxhash64(F.lit(seed), F.col("key"), F.col("shard")), blocks)
    chosen = F.aggregate(
        F.sequence(F.floor(start / block), F.floor((F.col("stop") - 1) / block)), F.lit(0).cast("long"),
        lambda sum_, b: sum_ + F.when(
            F.pmod(b * step + turn, blocks) < rest,
            F.least(F.col("stop"), (b + 1) * block) - F.greatest(start, b * block)).otherwise(0).cast("long"))
    taken = F.when(F.col("size") > 0, F.floor(F.col("quota") / blocks) * F.col("size") + chosen).otherwise(0).cast("long")
    return laid.select(
        *keys, "doc_id", "size", "source", "source_size", "target", taken.alias("taken"), F.struct("key", "shard").alias("shard"), "place", "digest")


def copies(spark: SparkSession, rows: DataFrame, key: str, **options) -> DataFrame:
    """(key, copies): how often a mix of whole rows takes each row of ``rows`` (key, doc_id, text, source).

    Along the seeded order of a shard, a row taken in part is rounded to the
    side that brings the words emitted so far nearer to the words taken so far.
    A shard has a bounded number of rows on average.
    """
    def settle(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["place", key], kind="stable")
        behind, out = 0, []
        for size, taken in zip(shard["size"].tolist(), shard["taken"].tolist(), strict=True):
            n = taken // size if size else 0
            behind += taken - n * size
            if size and taken % size and 2 * behind >= size:
                n, behind = n + 1, behind - size
            out.append(n)
        return pd.DataFrame({key: shard[key], "copies": out})

    laid = mix(spark, rows, keys=(key,), **options)
    kind = rows.schema[key].dataType.simpleString()
    return laid.select(key, "shard", "place", "size", "taken").groupBy("shard").applyInPandas(settle, f"{key} {kind}, copies int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")
