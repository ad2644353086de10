"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflux.llm import decontaminate, mixing, sharding, simhash, toxicity
from meshflux.llm.common import Lineage, attach, fresh, keyed, quoted

#: Near-duplicates share this many per cent of their five-word shingles.
SHINGLE, PERCENT = 5, 80
#: Differing bits up to which fingerprints are candidates; bands of minima find the others.
DISTANCE = 4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold, learned from the labels of ``sf_dir``.

    Rows keep their columns. A null text is scored like an empty one, by
    features that are all zero; repeated rows and ties score alike and go or stay
    together; texts of any length are scored whole, and an empty table gives an empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(spark, docs.select("doc_id", "text"), labels)
    score = fresh(docs.columns, "score")
    return model.score(docs, "text", score).where(F.col(score) < toxicity.THRESHOLD).select(*quoted(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, and one of rows that repeat it.

    Candidates are links of SimHash fingerprints of five-word shingles; a link
    counts if the shingles of the two texts have a Jaccard similarity of 0.8 or
    more. Equal texts (A-Z lower-cased, split into words) are one text. Texts
    without words are equal to each other and to null. Texts of any length are
    compared whole; all columns go through; an empty table gives an empty result.
    """
    return simhash.keep_one(spark, docs, SHINGLE, DISTANCE, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, as ``decontaminate.overlaps`` finds them.

    Null and empty texts hold no passage and stay; repeated rows go or stay
    together; texts of any length are searched whole; an empty table or benchmark drops nothing.
    """
    return decontaminate.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole copies that bring the words of each source near its target.

    Copies keep their doc_id. Documents that the mix takes too little of, and
    those without words, are left out.
    """
    rows, key = keyed(docs)
    copies = mixing.copies(spark, rows.select(key, F.col("doc_id").cast("long").alias("doc_id"), "text", "source"), key)
    number, copy = fresh(rows.columns, "copies"), fresh(rows.columns, "copy")
    taken = Lineage(spark).cut(copies.where("copies > 0").withColumnRenamed("copies", number))
    return attach(rows, taken, [key]).select(*quoted(docs.columns), F.explode(F.sequence(F.lit(1), F.col(number))).alias(copy)).drop(copy)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with all their columns, their shard, of near equal bytes, and their slot in it.

    Equal texts, null and empty ones too, share a shard; copies of a row have
    slots of their own; texts of any length count whole; an empty table gives an empty result.
    """
    return sharding.sharded(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: SQL expresses neither the trees of the first stage nor XXH64 in the second; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written and read again."""
    lineage = Lineage(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        following = lineage.cut(stage(spark, docs, sf_dir))
        lineage.drop(docs)
        docs = following
    return docs
