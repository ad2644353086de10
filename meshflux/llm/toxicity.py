"""Toxicity: boosted trees over dense lexical features of whole texts, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshflux.llm.common import ALNUM, FOLD, Lineage, ascii_lower, byte_class, find_sorted, fold_table, fresh, hash_of, hash_words, quoted, small_batches, text_buffers, text_slices, whole_text

#: Labelled rows that the lexicon, the trees and the calibration learn from, about: a seeded hash keeps the share that
#: gives this many. Scoring covers all rows.
LABELLED_ROWS = 30_000
#: Words of a lexicon, and the texts of the rarer class that must hold one.
LEXICON_WORDS, LEAST_TEXTS = 1000, 3
#: Lower bound of the log odds that makes a word lexical, and the normal quantile of the bound.
LEAST_ODDS, QUANTILE = 1.0, 1.64
#: Words between a lexical word and a second person that count as near.
NEAR = 5
THRESHOLD = 0.7
SEED = 20240229

# Words that address the reader, in English, French, German and Spanish.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine",
    "ihr", "euch", "euer", "ti", "tus", "usted", "ustedes", "vosotros")
# Characters that stand for letters.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FEATURES = (
    "weight_per_word", "lexical_per_word", "lexical", "weight_most", "near_second_person", "second_person_per_word", "capitals", "exclamations", "punctuation",
    "symbols", "disguised_per_word", "disguised", "words")

_DISGUISED = byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@$!", True)
_UNDISGUISE = fold_table({ord(a): ord(b) for a, b in DISGUISES.items()})
_CAPITAL, _LETTER, _EXCLAIM = (byte_class(x, False) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"!?"))
_PUNCTUATION, _SYMBOL = byte_class(b"!\"'(),-.:;?", False), byte_class(b"#$%&*+/<=>@[\\]^_`{|}~", False)
_SLICE = 1 << 18


@dataclass
class Lexicon:
    """Hashes of lexical words in order, and their weights."""

    hashes: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, words: dict[str, float]) -> Lexicon:
        hashes = hash_of(list(words))
        turn = np.argsort(hashes)
        return cls(hashes[turn], np.array(list(words.values()), float)[turn])


_SECOND = np.sort(hash_of(list(SECOND_PERSON)))


def _features(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text of ``data``."""
    n = len(offsets) - 1
    sizes = np.maximum(1, np.diff(offsets))

    def held(member: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(member[data], dtype=np.int64)])[offsets])

    def of(starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, starts, side="right") - 1

    starts, hashes = hash_words(data, offsets, ALNUM, FOLD)
    cuts = np.searchsorted(starts, offsets)
    words = np.maximum(1, np.diff(cuts))
    found = find_sorted(lexicon.hashes, hashes)
    at = np.flatnonzero(found >= 0)
    weight, row = lexicon.weights[found[at]] if len(at) else np.zeros(0), of(starts[at])
    hits = np.bincount(row, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, row, weight)
    second = np.concatenate([[0], np.cumsum(find_sorted(_SECOND, hashes) >= 0)])
    near = second[np.minimum(at + NEAR + 1, cuts[row + 1])] > second[np.maximum(at - NEAR, cuts[row])]

    # Words that are lexical only once disguises are undone.
    hidden_starts, hidden = hash_words(data, offsets, _DISGUISED, _UNDISGUISE)
    hidden_at = hidden_starts[find_sorted(lexicon.hashes, hidden) >= 0]
    hidden_row = of(hidden_at[~np.isin(hidden_at, starts[at])])
    disguised = np.bincount(hidden_row, minlength=n)

    return np.column_stack([
        np.bincount(row, weight, n) / words, hits / words, np.log1p(hits), most, np.bincount(row, near, n) / np.maximum(1, hits),
        np.diff(second[cuts]) / words, held(_CAPITAL) / np.maximum(1, held(_LETTER)), held(_EXCLAIM) / sizes, held(_PUNCTUATION) / sizes,
        held(_SYMBOL) / sizes, disguised / words, np.log1p(disguised), np.log1p(np.diff(cuts))])


def features(rows: DataFrame, text: str, lexicon: Lexicon, name: str = "features") -> DataFrame:
    """``rows`` with an array column ``name``: the features of the whole text."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    # The text comes last, without nulls; all columns go through as they are.
    body = rows.withColumn(name, whole_text(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.columns[-1])
            parts = [_features(lexicon, some, marks) for _, some, marks in text_slices(data, offsets, _SLICE)]
            flat = np.concatenate([np.zeros((0, len(FEATURES))), *parts])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(FEATURES), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=schema.names)

    return body.mapInArrow(run, schema)


@dataclass
class Model:
    """What scores a text. ``trees`` is None where the labels had one class only: then ``prior`` is every score."""

    prior: float
    lexicon: Lexicon | None = None
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def score(self, rows: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """``rows`` with a column ``name``: the calibrated probability of the label."""
        if self.trees is None:
            return rows.withColumn(name, F.lit(self.prior))
        used = [*rows.columns, name]
        vector, margin, out = (fresh(used, x) for x in ("vector", "margin", "calibrated"))
        trees = self.trees.setFeaturesCol(vector).setRawPredictionCol(margin).setProbabilityCol("").setPredictionCol("")
        found = trees.transform(features(rows, text, self.lexicon, vector).withColumn(vector, array_to_vector(vector)))
        found = found.withColumn(margin, vector_to_array(margin)[1])
        found = self.calibration.setFeaturesCol(margin).setPredictionCol(out).transform(found)
        return found.select(*quoted(rows.columns), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(out))).alias(name))


def for_learning(doc_id: Column) -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 != 1


def _lexicons(rows: DataFrame) -> dict[str, dict[str, float]]:
    """Lexicons a, b and all, of the halves and of both, from (text, toxic, half)."""
    totals = rows.groupBy("half").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    toxic, clean = ({r.half: v for r, v in zip(totals, x, strict=True)} for x in ([r.t for r in totals], [r.n - r.t for r in totals]))
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)))).alias("word"), "toxic", "half")
    counts = words.groupBy("word").agg(*[
        F.sum(F.when(F.col("half") == h, F.col("toxic") if kind == "t" else 1 - F.col("toxic")).otherwise(0)).alias(f"{kind}_{h}")
        for h in ("a", "b") for kind in ("t", "c")])
    sums = counts.withColumns({"t_all": F.col("t_a") + F.col("t_b"), "c_all": F.col("c_a") + F.col("c_b")})
    sums = sums.where(F.col("t_all") >= LEAST_TEXTS).persist()  # few words: those of enough toxic texts
    out = {}
    for name, halves in (("a", "a"), ("b", "b"), ("all", "ab")):
        n_toxic, n_clean = (max(1, sum(x.get(h, 0) for h in halves)) for x in (toxic, clean))
        t, c = F.col(f"t_{name}") + 0.5, F.col(f"c_{name}") + 0.5
        odds = F.log(t / (n_toxic + 1.0)) - F.log(c / (n_clean + 1.0))
        bound = odds - QUANTILE * F.sqrt(1 / t + 1 / c)
        best = sums.where(F.col(f"t_{name}") >= LEAST_TEXTS).select("word", odds.alias("odds"), bound.alias("bound")).where(F.col("bound") > LEAST_ODDS)
        out[name] = {r.word: min(8.0, r.odds) for r in best.orderBy(F.desc("bound"), "word").limit(LEXICON_WORDS).collect()}
    sums.unpersist()
    return out


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Learn from the labels whose crc32(doc_id as text) mod 3 is not 1.

    About ``labelled_rows`` labelled texts are used, drawn by a seeded hash. A
    fifth calibrates. The rest is halved: the lexicon of one half makes the
    features of the other, so the trees never see a text through words that it
    chose itself; texts to score use the lexicon of both. Labels other than 0
    and 1, and null doc_ids, are left out; of several labels of a document the
    larger holds.
    """
    small_batches(spark)
    lineage = Lineage(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & for_learning(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = lineage.cut(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = ((toxic or 0) + 0.5) / (n + 1.0)
    if not toxic or toxic == n:
        return Model(prior)
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1_000_000))
    known = lineage.cut(known.where(draw < int(1_000_000 * min(1.0, labelled_rows / n))))  # at most about labelled_rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(F.broadcast(known), "doc_id")
    fold = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("doc_id")), F.lit(5))
    texts = lineage.cut(texts.withColumn("half", F.when(fold < 2, "a").when(fold < 4, "b").otherwise("held")))
    lexicons = {k: Lexicon.of(words) for k, words in _lexicons(texts.where("half != 'held'")).items()}
    seen = [features(texts.where(F.col("half") == half), "text", lexicons[other]) for half, other in (("a", "b"), ("b", "a"), ("held", "all"))]
    rows = seen[0].unionByName(seen[1]).unionByName(seen[2]).select("doc_id", "half", F.col("toxic").cast("double").alias("label"), "features")
    rows = lineage.cut(rows.withColumn("features", array_to_vector("features")).repartition(4, "doc_id").sortWithinPartitions("doc_id"))
    boost, held = rows.where("half != 'held'"), rows.where("half = 'held'")
    if boost.agg(F.countDistinct("label")).first()[0] < 2 or held.isEmpty():
        return Model(prior)
    # The bounded sample is small: one partition each spares a round of tasks for every level of every tree.
    boost = boost.coalesce(2).persist()
    trees = GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=30, maxDepth=3, stepSize=0.2, minInstancesPerNode=5, maxBins=64, seed=SEED).fit(boost)
    boost.unpersist()
    margins = trees.transform(held).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    calibration = IsotonicRegression(labelCol="label", featuresCol="margin").fit(margins.coalesce(1))
    lineage.release()
    return Model(prior, lexicons["all"], trees, calibration)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document.

    Null and empty texts are scored by their features, all zero. With labels of
    one class, or none, every score is the smoothed share of the label. Repeated
    rows score alike; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.score(docs)
    return scored.select(
        "doc_id", F.coalesce(~for_learning(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
