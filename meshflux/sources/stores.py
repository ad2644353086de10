"""Reference tables, payloads, exports and fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflux.operators.traversal import components
from meshflux.session import cut

# --- nested payloads ---------------------------------------------------------

DISEASE_PAYLOAD = """struct<id: string, name: string, synonyms: array<struct<relation: string, terms: array<string>>>, dbXRefs: array<string>,
parents: array<struct<id: string, name: string>>, associatedTargets: struct<rows: array<struct<score: double,
datatypeScores: array<struct<id: string, score: double>>, target: struct<id: string, approvedSymbol: string, approvedName: string>>>>>"""


def ontology_id(disease_id: Column, references: Column) -> Column:
    """``MONDO_1`` or ``mondo:1`` among the id and the cross references as ``MONDO:1``."""
    every = F.transform(F.concat(F.array(disease_id), F.coalesce(references, F.array().cast("array<string>"))), lambda x: F.upper(F.trim(x)))
    hits = F.filter(every, lambda x: x.startswith("MONDO_") | x.startswith("MONDO:"))
    return F.regexp_replace(F.get(hits, F.lit(0)), "^MONDO_", "MONDO:")


def parse_diseases(payloads: DataFrame, *, column: str = "payload") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Diseases, their synonyms, and their associations from JSON payloads."""
    rows = payloads.select(F.from_json(column, DISEASE_PAYLOAD).alias("d")).where("d.id IS NOT NULL")
    diseases = rows.select(
        F.col("d.id").alias("disease_id"), F.col("d.name").alias("name"), ontology_id(F.col("d.id"), F.col("d.dbXRefs")).alias("ontology_id"),
        F.coalesce(F.transform("d.parents", lambda p: F.coalesce(p["name"], p["id"])), F.array().cast("array<string>")).alias("parents"))
    words = F.flatten(F.transform("d.synonyms", lambda s: s["terms"]))
    synonyms = rows.select(F.col("d.id").alias("disease_id"), F.explode(F.array_distinct(F.transform(words, lambda w: F.trim(w)))).alias("synonym")).where("synonym <> ''")
    links = rows.select(F.col("d.id").alias("disease_id"), F.explode("d.associatedTargets.rows").alias("r")).select(
        "disease_id", F.col("r.target.id").alias("target_id"), F.col("r.target.approvedSymbol").alias("symbol"), F.col("r.score").alias("score"),
        F.map_from_entries(F.transform("r.datatypeScores", lambda s: F.struct(s["id"], s["score"]))).alias("evidence"))
    return diseases, synonyms, links


ANNOTATION_PAYLOAD = "struct<entity: string, version: string, results: array<struct<id: string, name: string, type: string>>>"


def parse_annotations(payloads: DataFrame, *, source: str, column: str = "payload", limit: int | None = None) -> DataFrame:
    """Distinct annotation rows with source and version from saved responses."""
    rows = payloads.select(F.from_json(column, ANNOTATION_PAYLOAD).alias("p")).where("p.entity IS NOT NULL")
    results = F.array_distinct("p.results")
    results = results if limit is None else F.slice(results, 1, limit)
    kept = rows.select(F.col("p.entity").alias("entity"), F.col("p.version").alias("version"), F.explode_outer(results).alias("r"))
    return kept.select("entity", F.lit(source).alias("source"), "version", F.col("r.id").alias("term"), F.col("r.name").alias("name"), F.col("r.type").alias("kind")).where("term IS NOT NULL").distinct()


PUBLICATION_PAYLOAD = "array<struct<publication_id: string, pmid: string, pmcid: string, doi: string, title: string, year: int, abstract: string, genes: array<string>>>"


def parse_publications(payloads: DataFrame, *, column: str = "payload") -> DataFrame:
    """Publications of provider responses, cleaned and one row per id."""
    rows = payloads.select(F.explode(F.from_json(column, PUBLICATION_PAYLOAD)).alias("p")).select("p.*")
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")).alias(c)
    out = rows.select(*[clean(c) for c in ("publication_id", "pmid", "pmcid", "doi", "title", "abstract")], "year", "genes").where("publication_id IS NOT NULL")
    return out.groupBy("publication_id").agg(*[F.min_by(c, F.struct("title", "year", "pmid")).alias(c) for c in out.columns if c != "publication_id"])


def co_mentions(publications: DataFrame, query: DataFrame) -> DataFrame:
    """Publications that name a target and a response of one query."""
    named = publications.select("publication_id", F.explode("genes").alias("gene")).distinct()
    sides = named.join(query.select("gene", "side"), "gene").groupBy("publication_id").agg(
        F.bool_or(F.col("side") == "target").alias("t"), F.bool_or(F.col("side") == "response").alias("r"))
    kind = F.when(F.col("t") & F.col("r"), "co_mention").when(F.col("t"), "target_only").otherwise("response_only")
    return sides.select("publication_id", kind.alias("label"))


# --- upserts -----------------------------------------------------------------

def replace_by_key(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the fresh keys replaced."""
    kept = table.join(fresh.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh.select(table.columns))


def ordered_associations(table: DataFrame) -> DataFrame:
    return table.orderBy(F.col("score").desc_nulls_last(), "symbol", "target_id")


IDENTIFIERS = ("publication_id", "pmid", "pmcid", "doi")


def merge_publications(rows: DataFrame) -> DataFrame:
    """One row per publication linked by any identifier; the earliest row wins a field.

    ``rows(row_id, publication_id, pmid, pmcid, doi, ..)``. Chains (a shares a
    pmid with b, b a doi with c) end in one component. Each identifier is linked
    to its first row, so a repeated identifier never makes all pairs.
    """
    rows = cut(rows)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(F.trim(F.col(k).cast("string"))).alias("value")) for k in IDENTIFIERS])
    ids = rows.select("row_id", F.explode(kinds).alias("i")).where("i.value IS NOT NULL AND i.value <> ''").select("row_id", "i.kind", "i.value")
    first = ids.groupBy("kind", "value").agg(F.min("row_id").alias("first"))
    links = ids.join(first, ["kind", "value"]).where("row_id <> first").select(F.col("first").alias("src"), F.col("row_id").alias("dst"))
    member = components(links.distinct(), vertices=rows.select(F.col("row_id").alias("id")))
    joined = rows.join(member.withColumnRenamed("id", "row_id"), "row_id")
    fields = [c for c in rows.columns if c != "row_id"]
    return joined.groupBy("component").agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("row_id"))).alias(c) for c in fields], F.count(F.lit(1)).alias("merged_rows")
    ).withColumnRenamed("component", "row_id")


# --- persisted edges ---------------------------------------------------------

def write_edges(edges: DataFrame, path: str, *, fingerprint: str, partitions: int | None = None) -> None:
    """Persist edges sorted by src with the fingerprint of their source."""
    parts = partitions or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges.withColumn("source_fingerprint", F.lit(fingerprint)).repartitionByRange(parts, "src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(path)


def read_edges(spark: SparkSession, path: str, *, fingerprint: str) -> DataFrame:
    """Persisted edges; a table built from another source is refused."""
    table = spark.read.parquet(path)
    if not table.where(~F.col("source_fingerprint").eqNullSafe(F.lit(fingerprint))).isEmpty():
        raise ValueError("persisted edges are stale: source fingerprint differs")
    return table.drop("source_fingerprint")


def with_metadata(df: DataFrame, metadata: Mapping[str, object]) -> DataFrame:
    """Metadata repeated as columns on every row, for export."""
    return df.withColumns({k: F.lit(v) for k, v in metadata.items()})


def with_provenance(df: DataFrame, provenance: Mapping[str, object]) -> DataFrame:
    """Provenance as one JSON column."""
    return df.withColumn("provenance", F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(provenance.items())])))


def export_csv(df: DataFrame, path: str, *, metadata: Mapping[str, object] | None = None) -> None:
    with_metadata(df, metadata or {}).write.mode("overwrite").option("header", True).csv(path)


# --- fingerprints and health -------------------------------------------------

def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-free digest of a table, in one aggregation.

    Two independent 64-bit row hashes are combined by XOR and by sum, so repeated
    rows count. Rows never meet in one task.
    """
    names = list(columns or sorted(df.columns))
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in names])
    half = lambda start: F.conv(F.substring(F.sha2(text, 256), start, 15), 16, 10).cast("bigint")
    rows = df.select(half(1).alias("a"), half(16).alias("b"))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("a").alias("xor"), F.sum(F.pmod("b", F.lit(2 ** 31 - 1))).alias("sum")
    ).select("rows", F.sha2(F.concat_ws(":", "rows", "xor", "sum"), 256).alias("fingerprint"))


def graph_fingerprint(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Digest of the node ids and the canonical edges; direction and order of the input do not matter.

    Weights and distances count with every digit; ``vertices(id)`` adds nodes
    without edges.
    """
    canonical = edges.select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").cast("string").alias("weight"),
        F.col("distance").cast("double").cast("string").alias("distance"), F.col("is_bridge").cast("string").alias("is_bridge"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if vertices is not None:
        nodes = nodes.unionByName(vertices.select("id"))
    nodes = nodes.distinct().select(F.col("id").alias("src"), *[F.lit(None).cast("string").alias(c) for c in canonical.columns[1:]])
    return table_fingerprint(canonical.unionByName(nodes))


def inspect_schema(tables: Mapping[str, DataFrame | None], declared: Mapping[str, tuple[Sequence[str], bool]], spark: SparkSession) -> DataFrame:
    """One row per declared dataset: present, missing columns, status.

    ``declared`` maps a name to its columns and whether it is required.
    """
    rows = []
    for name, (columns, required) in declared.items():
        table = tables.get(name)
        missing = sorted(set(columns) - set(table.columns)) if table is not None else list(columns)
        status = "READY" if table is not None and not missing else ("UNAVAILABLE" if required else "PARTIAL")
        rows.append((name, required, table is not None, ";".join(missing), status))
    return spark.createDataFrame(rows, "dataset string, required boolean, present boolean, missing string, status string")


def inspect_rows(tables: Mapping[str, DataFrame], declared: Mapping[str, tuple[Sequence[str], bool]]) -> DataFrame:
    """Rows of each present dataset, and how many lack a value in a declared column: ``dataset, rows, incomplete``."""
    out = None
    for name, table in tables.items():
        held = [c for c in declared[name][0] if c in table.columns]
        lacking = F.lit(False)
        for column in held:
            lacking = lacking | F.col(column).isNull()
        part = table.agg(F.count(F.lit(1)).alias("rows"), F.count_if(lacking).alias("incomplete")).select(F.lit(name).alias("dataset"), "rows", "incomplete")
        out = part if out is None else out.unionByName(part)
    return out


def overall_status(checks: DataFrame) -> DataFrame:
    worst = F.when(F.bool_or(F.col("status") == "UNAVAILABLE"), "UNAVAILABLE").when(F.bool_or(F.col("status") == "PARTIAL"), "PARTIAL").otherwise("READY")
    return checks.agg(worst.alias("status"))


# --- expiry ------------------------------------------------------------------

# Lifetimes in seconds by class of evidence, and for failures.
LIFETIMES = {"entity_resolution": 2592000, "biological_annotation": 2592000, "pathway_annotation": 1209600, "literature": 604800}
NEGATIVE_LIFETIME = 21600
TRANSIENT_LIFETIME = 60


def lifetime(status: Column, evidence_class: Column) -> Column:
    """Seconds a stored result stays valid; null when it must not be kept."""
    known = F.lit(None).cast("int")
    for name, seconds in LIFETIMES.items():
        known = F.when(evidence_class == name, seconds).otherwise(known)
    return F.when(status == "NO_MATCH", NEGATIVE_LIFETIME).when(status.isin("TIMEOUT", "RATE_LIMITED", "PROVIDER_ERROR"), TRANSIENT_LIFETIME).when(
        status == "AVAILABLE", known)


def live_results(snapshots: DataFrame, now: Column, keys: Sequence[str]) -> DataFrame:
    """Latest stored result per key that has not expired at ``now``."""
    seconds = lifetime(F.col("status"), F.col("evidence_class"))
    valid = snapshots.withColumn("expires_at", F.col("retrieved_at") + F.make_dt_interval(secs=seconds)).where(F.col("expires_at") > now)
    fields = [c for c in valid.columns if c not in keys]
    best = valid.groupBy(*keys).agg(F.max_by(F.struct(*fields), "retrieved_at").alias("r"))
    return best.select(*keys, "r.*")
