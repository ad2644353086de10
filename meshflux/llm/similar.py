"""Exact Jaccard links among texts that share a bucket, without writing all pairs of a bucket."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshflux.llm.common import Lineage
from meshflux.llm.linking import components

#: Nodes of a bucket that meet all others in the first round, about, and how many times as many in the next.
_FIRST_MET, _TIMES_MET = 2, 16
#: Longs of a sketch for the lowest bits of minima and for parities, and the chance that the minima hide a pair of just the similarity asked for.
MINIMA, PARITIES, HIDDEN = 3, 16, 1e-9


def most_differing(bits: int, percent: int) -> int:
    """Bits up to which sketches of ``bits`` bits may differ: more has a chance of HIDDEN at a similarity of ``percent``.

    A bit is the lowest of a minimum, so it differs with half the chance that minima do.
    """
    p, tail, n = (100 - percent) / 200, 0.0, bits
    while n:
        tail += math.comb(bits, n) * p**n * (1 - p) ** (bits - n)
        if tail > HIDDEN:
            break
        n -= 1
    return n


def sketch(minima: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Lowest bits of the minima, then how many of the hashes fall on each of 1,024 places, modulo 2.

    Parities of two sets differ in no more places than the sets have elements
    apart, so they never hide a similar pair; the minima hide few.
    """
    bits = np.zeros((MINIMA + PARITIES) * 64, np.uint8)
    bits[: len(minima)] = minima & np.uint32(1)
    places = (hashes >> np.uint64(40)).astype(np.int64) % (PARITIES * 64)
    bits[MINIMA * 64 :] = np.bincount(places, minlength=PARITIES * 64) & 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _near(percent: int, bits: int) -> Column:
    """Whether sizes and sketches of a and b allow the similarity."""
    def differing(low: int, high: int) -> Column:
        return sum((F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(low, high)), F.lit(0))

    sizes = F.col("a.size") + F.col("b.size")
    near = (F.col("a.size") * 100 >= F.col("b.size") * percent) & (F.col("b.size") * 100 >= F.col("a.size") * percent)
    near &= differing(0, MINIMA) <= most_differing(bits, percent)
    return near & (differing(MINIMA, MINIMA + PARITIES) * (100 + percent) <= sizes * (100 - percent))


def united(lineage: Lineage, nodes: DataFrame, buckets: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, bits: int) -> DataFrame:
    """(node, root) of every node that links to another: root is the smallest node of its component.

    ``nodes`` (node, size, sketch) is a cut table of numbered texts, ``buckets``
    (bucket, node) their candidates, ``sets`` gives (node, set) of a table of
    nodes, and a link is a Jaccard similarity of ``percent`` or more on those
    sets. Buckets with the same members are one. In a round the next nodes of a
    bucket, in a random order that all buckets share, meet all nodes of it that
    are still apart from them, and a pair is written if sizes and sketches allow
    the similarity; then sets are compared, roots united, and buckets with one
    root and those whose nodes have all met are closed. A round takes
    many times the nodes of the one before, so rounds follow the logarithm of
    the largest bucket, and a group of copies costs a few pairs a member.
    """
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("members"), F.min("node").alias("low"))
    sizes = sizes.where("n > 1").groupBy("n", "members", "low").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    turn = (F.pmod(F.xxhash64("node"), F.lit(1 << 31)) / F.lit(1 << 31) * F.col("n")).alias("turn")
    names = [f"s{k}" for k in range(MINIMA + PARITIES)]
    parts = [F.col("sketch")[k].alias(name) for k, name in enumerate(names)]
    shared = F.sum("n").over(Window.partitionBy("node")).alias("shared")
    held = buckets.join(sizes, "bucket").select("bucket", "node", "n", shared).join(nodes.select("node", "size", *parts), "node")
    held = lineage.cut(held.select("bucket", "node", F.col("node").alias("root"), "n", turn, "shared", "size", *names))
    rooted = known = None
    met, reach = 0, _FIRST_MET
    while True:
        apart = held.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max_by("node", "shared").alias("hub")).where("low < high")
        # Nodes that have met all others of the bucket are done.
        before, held = held, lineage.cut(held.where((F.col("turn") >= met) & (F.col("n") > met)).drop("hub").join(apart.select("bucket", "hub"), "bucket"))
        lineage.drop(before)
        if held.isEmpty():
            break
        first = (F.col("turn") < reach) | (F.col("node") == F.col("hub")) & F.lit(met == 0)
        a, b = held.where(first).alias("a"), held.alias("b")
        near = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.root") != F.col("b.root")) & _near(percent, bits)
        ends = [F.struct(f"{x}.node", f"{x}.root") for x in ("a", "b")]
        pairs = a.join(b, near).select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()
        pairs = lineage.cut(pairs.select(*[F.col(f"{x}.{y}").alias(f"{y}_{x}") for x in ("a", "b") for y in ("node", "root")]))
        needed = pairs.select(F.col("node_a").alias("node")).union(pairs.select("node_b")).distinct()
        if known is not None:
            needed = needed.join(known.select("node"), "node", "left_anti")
        fresh = lineage.cut(sets(lineage.cut(needed)))
        known = fresh if known is None else known.unionByName(fresh)
        both = pairs
        for x in ("a", "b"):
            both = both.join(known.select(F.col("node").alias(f"node_{x}"), F.col("set").alias(f"set_{x}")), f"node_{x}")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        linked = both.where(shared * 100 >= (F.size("set_a") + F.size("set_b") - shared) * percent)
        linked = lineage.cut(linked.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
        lineage.drop(pairs)
        if not linked.isEmpty():
            roots = components(lineage, linked).select(F.col("node").alias("root"), F.col("root").alias("onto"))
            moved = F.coalesce("onto", "root").alias("root")
            before, held = held, lineage.cut(held.join(roots, "root", "left").select(*[moved if c == "root" else c for c in held.columns]))
            lineage.drop(before)
            joined = roots.select(F.col("root").alias("node"), F.col("onto").alias("root"))
            if rooted is None:
                rooted = joined
            else:  # nodes that hung on a root go with it; roots of this round are new or were roots before
                hung = rooted.join(roots, "root", "left").select("node", moved)
                rooted = lineage.cut(hung.unionByName(joined.join(hung.select("node"), "node", "left_anti")))
        met, reach = reach, reach * _TIMES_MET
    return nodes.select("node", F.col("node").alias("root")).limit(0) if rooted is None else rooted
