"""Term clean-up, symbol mentions, ranked text search and passages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshflux.session import cut

# Words that mean "no value", words a search ignores, and the
# patterns of a token, a sentence end and a term separator.
NULL_WORDS = ("", "nan", "none", "n/a", "na", "veri yok")
STOPWORDS = (
    "and", "or", "the", "a", "an", "of", "in", "to", "for", "with", "on", "by", "from", "is", "are", "was", "were", "current", "result",
)
TOKEN = r"[A-Za-z0-9]+(?:[-_:][A-Za-z0-9]+)*"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"
TERM_BREAK = r"\s*(?:\||;|\n|,\s*(?=[A-Z]{2,}|GO:|KEGG:))\s*"


def clean_term(value: Column | str) -> Column:
    """Trimmed single-spaced text; null words become null."""
    v = F.trim(F.regexp_replace(F.col(value) if isinstance(value, str) else value, r"\s+", " "))
    return F.when(~F.lower(v).isin(*NULL_WORDS), v)


def split_terms(value: Column | str) -> Column:
    """Distinct terms of a JSON array or a separated string, first order kept."""
    v = F.col(value) if isinstance(value, str) else value
    listed = F.when(v.rlike(r"^\s*\["), F.from_json(v, "array<string>")).otherwise(F.split(v, TERM_BREAK))
    cleaned = F.transform(listed, clean_term)
    return F.coalesce(F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def tokens(value: Column | str) -> Column:
    """Lower-case word tokens."""
    v = F.col(value) if isinstance(value, str) else value
    return F.regexp_extract_all(F.lower(v), F.lit(f"({TOKEN})"), F.lit(1))


def symbol_mentions(texts: DataFrame, symbols: DataFrame, *, text: str = "text", key: str = "doc_id", minimum: int = 3) -> DataFrame:
    """Distinct (document, symbol) pairs for exact-token mentions of allowed symbols.

    A symbol is matched as a whole run of letters and digits. Documents are
    tokenised once and joined to the dictionary; symbols shorter than ``minimum``
    are left out.
    """
    allowed = symbols.select(F.upper(F.col("symbol").cast("string")).alias("symbol")).where(F.length("symbol") >= minimum).distinct()
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"([A-Z0-9]+)"), F.lit(1)))).alias("symbol"))
    return words.join(allowed, "symbol").select(key, "symbol")


def excluded_symbols(symbols: DataFrame, *, minimum: int = 3) -> DataFrame:
    return symbols.select(F.upper(F.col("symbol").cast("string")).alias("symbol")).where(F.length("symbol") < minimum).distinct()


def query_terms(query: str) -> list[str]:
    import re

    found = [w.lower() for w in re.findall(TOKEN, query)]
    return [w for w in dict.fromkeys(found) if len(w) >= 2 and w not in STOPWORDS]


def search_tfidf(docs: DataFrame, query: str, *, text: str = "text", key: str = "doc_id", limit: int = 20) -> DataFrame:
    """Documents ranked by the summed inverse document frequency of matched query terms.

    Only (document, query term) pairs leave the scan; whole texts are searched.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("matched")).where("false")
    wanted = F.array(*[F.lit(w) for w in terms])
    hits = cut(docs.select(key, F.explode(F.array_intersect(tokens(text), wanted)).alias("term")))
    size = docs.count()
    weights = hits.groupBy("term").agg((F.log(F.lit(size + 1.0) / (F.count(F.lit(1)) + 1.0)) + 1.0).alias("weight"))
    scored = hits.join(F.broadcast(weights), "term").groupBy(key).agg(  # one row per query term
        F.sum("weight").alias("score"), F.count(F.lit(1)).alias("matched"))
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(limit)


def search_bm25(docs: DataFrame, query: str, *, text: str = "text", key: str = "doc_id", limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Documents ranked by BM25 over the query terms."""
    terms = query_terms(query)
    wanted = F.array(*[F.lit(w) for w in terms]) if terms else F.array().cast("array<string>")
    words = docs.select(key, tokens(text).alias("words"))
    counted = words.select(key, F.size("words").alias("length"), F.transform(wanted, lambda w: F.struct(
        w.alias("term"), F.size(F.filter("words", lambda x: x == w)).alias("tf"))).alias("tfs"))
    counted = cut(counted)
    shape = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    hits = counted.select(key, "length", F.explode("tfs").alias("t")).where("t.tf > 0").select(key, "length", "t.term", "t.tf")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, mean = float(shape["n"]), float(shape["mean"] or 1.0)
    idf = F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("length") / F.lit(mean)))
    scored = hits.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(idf * part).alias("score"), F.count(F.lit(1)).alias("matched"))
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(limit)


def passages(
    docs: DataFrame, query: str, entities: Sequence[str], *, key: str = "doc_id", title: str | None = None, text: str = "text", limit: int = 3
) -> DataFrame:
    """The sentences of each document that share most entity and query terms.

    More entity hits first, then more query hits, the title, earlier sentences.
    Repeated sentences count once and are whole.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    names = F.array(*[F.lit(e.lower()) for e in dict.fromkeys(entities)])
    asked = [w for w in query_terms(query)]
    wanted = F.array(*[F.lit(w) for w in asked]) if asked else F.array().cast("array<string>")
    body = docs.select(key, F.lit("body").alias("section"), F.posexplode(F.split(text, SENTENCE_END)).alias("place", "sentence"))
    if title is not None:
        body = body.unionByName(docs.select(key, F.lit("title").alias("section"), F.lit(0).alias("place"), F.col(title).alias("sentence")))
    rows = body.withColumn("sentence", F.trim(F.regexp_replace("sentence", r"\s+", " "))).where("sentence <> ''")
    rows = rows.withColumn("words", F.array_distinct(tokens("sentence"))).select(
        key, "section", "place", "sentence",
        F.size(F.array_intersect("words", names)).alias("entity_hits"), F.size(F.array_intersect("words", wanted)).alias("query_hits"),
    ).where("entity_hits > 0 OR query_hits > 0")
    best = [F.desc("entity_hits"), F.desc("query_hits"), F.desc(F.col("section") == "title"), F.asc("place")]
    # One row per distinct sentence first, so the ranking window sees no copies.
    order = F.struct((-F.col("entity_hits")).alias("a"), (-F.col("query_hits")).alias("b"), (F.col("section") != "title").alias("c"), "place")
    unique = rows.groupBy(key, F.xxhash64(F.lower("sentence")).alias("_s")).agg(F.min_by(F.struct(
        "section", "place", "sentence", "entity_hits", "query_hits"), order).alias("r")).select(key, "r.*")
    ranked = unique.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*best)))
    return ranked.where(F.col("rank") <= limit)
