"""Readers of the source files: guarded schemas, coercion, mapping, build reports.

Every rule that refuses a file raises before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshflux.functions.measures import evidence_status
from meshflux.operators.evidence import CHANNELS
from meshflux.operators.signed import arc_status, sign_of
from meshflux.schema import OVERLAY, require_columns
from meshflux.session import cut
from meshflux.sources.tables import strip_prefix


class SourceError(ValueError):
    pass


# Header of the channel file, and relation names of the regulator file.
LINK_COLUMNS = ("protein1", "protein2", *CHANNELS, "combined_score")
RELATIONS = {"Activation": "activation", "Repression": "repression", "Unknown": "unknown"}


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Space-delimited channel file or files (gzip or plain) with the exact header: ``src, dst, line_no, channels``.

    ``line_no`` orders the rows by file, and in a file by their place. A compressed file is read by
    one task; its rows are spread out afterwards.
    """
    header = spark.read.text(path).limit(1).first()
    if header is None or tuple(header[0].split()) != LINK_COLUMNS:
        raise SourceError(f"unexpected channel file header: {header and header[0]}")
    schema = T.StructType([T.StructField(c, T.StringType() if c.startswith("protein") else T.IntegerType()) for c in LINK_COLUMNS])
    rows = spark.read.csv(path, sep=" ", header=True, schema=schema, mode="FAILFAST")
    # Within a file: the block it is read in, then the row's place among those of the task, which keeps their order.
    return rows.select(
        strip_prefix("protein1").alias("src"), strip_prefix("protein2").alias("dst"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).alias("line_no"),
        *CHANNELS, "combined_score")


def read_tsv(spark: SparkSession, path: str, *, header: bool = True, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", header)
    return reader.schema(schema).csv(path) if schema is not None else reader.csv(path)


def unique_map(mapping: DataFrame, key: str, value: str, *, reject_duplicates: bool = False) -> DataFrame:
    """Key to value where a key has exactly one value: ``key, value``.

    With ``reject_duplicates`` an ambiguous key refuses the file instead.
    """
    pairs = mapping.select(F.trim(key).alias("key"), F.trim(value).alias("value")).where("key <> '' AND value <> ''").distinct()
    grouped = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
    if reject_duplicates and not grouped.where("n > 1").isEmpty():
        raise SourceError("id mapping holds several values for a key")
    return grouped.where("n = 1").select("key", "value")


def expression_levels(raw: DataFrame, mapping: DataFrame, *, pattern: str = r"^ENSG\d+$") -> tuple[DataFrame, DataFrame]:
    """Context levels and the build report of an expression file.

    ``raw(Gene, Tissue, TPM)``, ``mapping(key, value)``. Ids must match the
    pattern, levels be numbers of at least zero; repeated rows keep the maximum.
    """
    require_columns(raw, "Gene", "Tissue", "TPM", what="expression file")
    rows = raw.select(F.trim("Gene").alias("gene"), F.trim("Tissue").alias("context"), F.expr("try_cast(TPM AS double)").alias("level"))
    rows = rows.withColumn("ok", F.coalesce(F.col("gene").rlike(pattern) & (F.col("context") != "") & (F.col("level") >= 0), F.lit(False)))
    valid = cut(rows.where("ok").groupBy("gene", "context").agg(F.max("level").alias("level")))
    if valid.isEmpty():
        raise SourceError("expression file holds no valid record")
    joined = cut(valid.join(mapping.select(F.col("key").alias("gene"), F.col("value").alias("id")), "gene", "left"))
    report = build_report(raw.count(), joined, "gene", "id")
    return joined.where("id IS NOT NULL").select("id", F.initcap("context").alias("context"), "level"), report


def regulator_tables(raw: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forward index, inverse index and canonical relations of a regulator file.

    ``raw(position, regulator, target, relation, reference)``. One unknown relation
    or empty symbol refuses the whole file. Both indexes are long tables.
    """
    rows = raw.select("position", F.trim("regulator").alias("regulator"), F.trim("target").alias("target"), "relation", F.coalesce("reference", F.lit("")).alias("reference"))
    wrong = rows.where("regulator IS NULL OR regulator = '' OR target IS NULL OR target = ''").unionByName(rows.where(~F.col("relation").isin(*RELATIONS) | F.col("relation").isNull()))
    if rows.isEmpty() or not wrong.isEmpty():
        raise SourceError("regulator file holds malformed or unsupported relations")
    label = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    forward = rows.select("regulator", "target").distinct()
    inverse = rows.select("target", "position", "regulator", label[F.col("relation")].alias("effect"))
    ends = mapping.select("key", "value")
    canonical = rows.join(ends.select(F.col("key").alias("regulator"), F.col("value").alias("regulator_id")), "regulator").join(
        ends.select(F.col("key").alias("target"), F.col("value").alias("target_id")), "target")
    return forward, inverse, canonical.select("regulator_id", "target_id", "relation", "reference")


def regulator_overlay(inverse: DataFrame) -> DataFrame:
    """Overlay rows of a regulator index; the effect is read from the relation text."""
    effect = F.lower("effect")
    up, down = effect.contains("activation"), effect.contains("repression")
    return project_overlay(inverse.select(
        F.col("regulator").alias("source"), "target", F.lit("source_to_target").alias("direction"), up.alias("stimulation"), down.alias("inhibition"),
        evidence_status(up, down, F.lit(True)).alias("evidence_status"), F.lit("regulators").alias("evidence_layer")))


def project_overlay(rows: DataFrame) -> DataFrame:
    """The fixed 14 overlay columns; absent ones are typed nulls."""
    return rows.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in OVERLAY])


def directed_overlay(
    spark: SparkSession, raw: DataFrame | None, *, version: str = "local_snapshot", organism: str = "Homo sapiens"
) -> tuple[DataFrame, bool]:
    """Overlay of a directed-evidence snapshot and whether it was available.

    A missing file is an empty overlay marked unavailable: no evidence against
    anything. Symbol columns are preferred to id columns.
    """
    if raw is None:
        return spark.createDataFrame([], OVERLAY), False
    have = set(raw.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have]) if have & set(names) else F.lit(None)
    flag = lambda *names: truthy(pick(*names))
    rows = raw.select(
        pick("source_genesymbol", "source").alias("source"), pick("target_genesymbol", "target").alias("target"),
        flag("is_stimulation").alias("stimulation"), flag("is_inhibition").alias("inhibition"), flag("consensus_direction", "is_directed").alias("consensus_direction"),
        flag("consensus_stimulation").alias("consensus_stimulation"), flag("consensus_inhibition").alias("consensus_inhibition"),
        F.array_join(items(pick("sources")), ";").alias("provenance"), F.array_join(items(pick("references")), ";").alias("references"),
        F.coalesce(pick("organism").cast("string"), F.lit(organism)).alias("organism"), F.lit(version).alias("snapshot_version"),
        F.lit("directed_regulatory").alias("evidence_layer"))
    rows = rows.withColumn("direction", F.when(F.col("consensus_direction"), "source_to_target"))
    # The status rests on the consensus flags; is_directed stands in for the direction where no consensus column exists.
    status = evidence_status("consensus_stimulation", "consensus_inhibition", "consensus_direction")
    return project_overlay(rows.withColumn("evidence_status", status)), True


def truthy(value) -> Column:
    return F.when(value.isNotNull(), F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y"))


def items(value) -> Column:
    """Sorted distinct parts of a ``;`` or ``|`` separated string."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"[;|]"), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


# Columns a signalling file must have.
SIGNALLING_COLUMNS = (
    "source", "target", "source_genesymbol", "target_genesymbol", "is_directed", "is_stimulation", "is_inhibition", "sources", "references")


# What stands before the id of an end that the mapping does not resolve, and before the id of a complex.
UNMAPPED, COMPLEX = "omnipath:", "COMPLEX:"


def verify_checksum(spark: SparkSession, path: str, expected: str | None) -> str:
    """SHA-256 of a file's bytes, streamed from its store; an error if it is not the expected one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        found = spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
    if expected and expected.lower() != found:
        raise SourceError(f"{path} does not have the checksum that its metadata states")
    return found


def numbered_rows(raw: DataFrame, name: str = "row_number", *, start: int = 2) -> DataFrame:
    """``raw``, read from files, with the number of each row: by file, then by place, from ``start`` (a header is line 1).

    A file is read in splits; rows are numbered inside their split, and the
    splits before it are added up, one row a split. So numbers do not depend on how a file was cut.
    """
    placed = cut(raw.select("*", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_split"), F.monotonically_increasing_id().alias("_place")))
    splits = placed.groupBy("_file", "_split").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    before = splits.select("_file", "_split", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    numbered = placed.join(before, ["_file", "_split"])
    return numbered.withColumn(name, F.col("_place") - F.col("_first") + F.col("_before") + F.lit(start)).drop("_file", "_split", "_place", "_first", "_before", "_n")


def signalling_rows(raw: DataFrame, mapping: DataFrame, *, minimum_rows: int = 1) -> DataFrame:
    """Rows of a signalling file with the node of either end, typed and whole: nothing is left out.

    An end is the id and symbol of its columns, both trimmed; the symbol resolves
    by ``mapping(key, value)``, and an end that does not keeps its own id behind
    ``UNMAPPED``. A row is ``usable`` if it is directed and both ends have an id and a
    symbol. A consensus flag stands before the raw one wherever it is there.
    """
    require_columns(raw, *SIGNALLING_COLUMNS, what="signalling file")
    if raw.limit(minimum_rows).count() < minimum_rows:
        raise SourceError("signalling file has too few rows")
    have = set(raw.columns)
    flag = lambda name: truthy(F.col(name)) if name in have else F.lit(None).cast("boolean")
    effort = F.expr("try_cast(curation_effort AS int)") if "curation_effort" in have else F.lit(0)
    rows = raw.select(
        *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(n) for c, n in (("source", "s_id"), ("target", "t_id"), ("source_genesymbol", "s"), ("target_genesymbol", "t"))],
        F.coalesce(flag("is_directed"), F.lit(False)).alias("directed"),
        F.coalesce(flag("consensus_stimulation"), flag("is_stimulation"), F.lit(False)).alias("up"),
        F.coalesce(flag("consensus_inhibition"), flag("is_inhibition"), F.lit(False)).alias("down"),
        *[F.coalesce(flag(c), F.lit(False)).alias(c) for c in ("consensus_direction", "consensus_stimulation", "consensus_inhibition")],
        items(F.col("sources")).alias("resources"), items(F.col("references")).alias("refs"), F.coalesce(effort, F.lit(0)).alias("effort"),
        (F.col("row_number") if "row_number" in have else F.lit(None).cast("long")).alias("row_number"))
    ends = mapping.select("key", "value")
    for symbol, node in (("s", "s_node"), ("t", "t_node")):
        rows = rows.join(ends.select(F.col("key").alias(symbol), F.col("value").alias(node)), symbol, "left")
    named = lambda i, n: (F.col(i) != "") & (F.col(n) != "")
    return rows.withColumns({
        "usable": F.col("directed") & named("s_id", "s") & named("t_id", "t"),
        "src": F.coalesce("s_node", F.concat(F.lit(UNMAPPED), "s_id")), "dst": F.coalesce("t_node", F.concat(F.lit(UNMAPPED), "t_id"))})


def signalling_edges(raw: DataFrame, mapping: DataFrame, *, minimum_rows: int = 1) -> tuple[DataFrame, DataFrame]:
    """Signed directed pairs of a signalling file, and its mapping report.

    Rows of one pair are merged: flags by OR, resources and references by set
    union, curation effort by sum. Loops and pairs with an end outside the
    mapping stay (``signalling_rows``). ``first_row`` and ``last_row`` are numbers of
    the raw rows where they are known; ``signalling_rows`` has them all.
    """
    rows = cut(signalling_rows(raw, mapping, minimum_rows=minimum_rows))
    usable = rows.where("usable")
    listed = lambda c: usable.select("src", "dst", F.explode(c).alias(c)).distinct().groupBy("src", "dst").agg(F.array_sort(F.collect_set(c)).alias(c))
    pairs = usable.groupBy("src", "dst").agg(
        F.bool_or("up").alias("stimulation"), F.bool_or("down").alias("inhibition"), *[F.bool_or(c).alias(c) for c in ("consensus_direction", "consensus_stimulation", "consensus_inhibition")],
        F.sum("effort").alias("effort"), F.count(F.lit(1)).alias("raw_rows"), F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"),
        F.max(F.col("s_node").isNotNull()).alias("src_mapped"), F.max(F.col("t_node").isNotNull()).alias("dst_mapped"))
    none = F.array().cast("array<string>")
    for c in ("resources", "refs"):  # distinct values first: a pair of many rows sends few
        pairs = pairs.join(listed(c), ["src", "dst"], "left").withColumn(c, F.coalesce(c, none))
    status = arc_status("stimulation", "inhibition")
    return pairs.withColumns({"status": status, "sign": sign_of(status)}), mapping_report(rows)


def signalling_nodes(rows: DataFrame) -> DataFrame:
    """``id, identifier, symbol, membership`` of all ends of ``signalling_rows``: the first identifier and symbol of a node."""
    ends = F.array(*[F.struct(F.col(i).alias("identifier"), F.col(n).alias("symbol"), F.col(m).alias("node"), F.col(e).alias("id")) for i, n, m, e in (("s_id", "s", "s_node", "src"), ("t_id", "t", "t_node", "dst"))])
    flat = rows.select(F.explode(ends).alias("e")).select("e.*").where("identifier <> '' AND symbol <> ''")
    first = F.min(F.struct("identifier", "symbol"))
    found = flat.groupBy("id").agg(first.alias("f"), F.max(F.col("node").isNotNull()).alias("mapped"))
    return found.select("id", "f.identifier", "f.symbol", F.when(F.col("mapped"), "both layers").otherwise("signalling only").alias("membership"))


def mapping_report(rows: DataFrame) -> DataFrame:
    """Counts and mapping rates of ``signalling_rows``, of all and of atomic entities, with the acceptance class."""
    ends = F.array(*[F.struct(F.col(i).alias("i"), F.col(n).alias("n"), F.col(m).alias("m")) for i, n, m in (("s_id", "s", "s_node"), ("t_id", "t", "t_node"))])
    names = rows.select(F.explode(ends).alias("e")).select("e.*").where("i <> '' AND n <> ''").distinct()
    atomic, mapped = ~F.col("i").startswith(COMPLEX), F.col("m").isNotNull()
    entities = names.agg(
        F.count(F.lit(1)).alias("entities"), F.count("m").alias("mapped_entities"), F.count_if(atomic).alias("atomic_entities"),
        F.coalesce(F.try_divide(F.count("m"), F.count(F.lit(1))), F.lit(0.0)).alias("entity_rate"),
        F.coalesce(F.try_divide(F.count_if(atomic & mapped), F.count_if(atomic)), F.lit(0.0)).alias("atomic_entity_rate"))
    s, t, usable = F.col("s_node").isNotNull(), F.col("t_node").isNotNull(), F.col("usable")
    simple = usable & ~F.col("s_id").startswith(COMPLEX) & ~F.col("t_id").startswith(COMPLEX)
    edges = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(usable & s & t).alias("fully_mapped"), F.count_if(usable & (s != t)).alias("partly_mapped"),
        F.count_if(usable & ~s & ~t).alias("signalling_only"), F.count_if(F.col("directed") & ~usable).alias("unusable"),
        F.coalesce(F.try_divide(F.count_if(usable & s & t), F.count(F.lit(1))), F.lit(0.0)).alias("edge_rate"),
        F.coalesce(F.try_divide(F.count_if(simple & s & t), F.count_if(simple)), F.lit(0.0)).alias("atomic_edge_rate"))
    return edges.join(F.broadcast(entities)).withColumn("acceptance", acceptance("entity_rate", "edge_rate"))  # one-row tables


def acceptance(entity_rate: str, edge_rate: str):
    return F.when(F.col(edge_rate) < 0.70, "FAILURE").when((F.col(entity_rate) < 0.90) | (F.col(edge_rate) < 0.85), "WARNING").otherwise("PREFERRED")


def complex_members(raw: DataFrame, mapping: DataFrame, *, organism: str = "Human") -> tuple[DataFrame, DataFrame]:
    """Members of the complexes of one organism, one row each, and the build report.

    ``raw(ComplexID, ComplexName, Organism, subunits)``. Membership is context; no
    pair of members ever becomes an edge.
    """
    require_columns(raw, "ComplexID", "ComplexName", "Organism", "subunits", what="complex file")
    chosen = raw.where(F.trim("Organism") == organism)
    if chosen.isEmpty():
        raise SourceError(f"complex file holds no {organism} record")
    if not chosen.where("trim(coalesce(ComplexID, '')) = '' OR trim(coalesce(ComplexName, '')) = ''").isEmpty():
        raise SourceError("complex file holds an empty id or name")
    parts = chosen.select(F.trim("ComplexID").alias("complex"), F.trim("ComplexName").alias("name"), F.explode(F.split("subunits", ";")).alias("symbol"))
    parts = parts.withColumn("symbol", F.trim("symbol")).where("symbol <> '' AND symbol <> 'None'")
    members = parts.groupBy("complex", "symbol").agg(F.min("name").alias("name"))
    joined = cut(members.join(mapping.select(F.col("key").alias("symbol"), F.col("value").alias("id")), "symbol", "left"))
    return joined, build_report(joined.count(), joined, "symbol", "id")


def second_species_edges(links: DataFrame, *, threshold: int = 500) -> DataFrame:
    """Scored pairs of the second dataset at or above the threshold."""
    return links.where(F.col("combined_score") >= threshold).select("src", "dst", F.col("combined_score").alias("score"))


def second_species_levels(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Positive levels of the second dataset by symbol; unmapped rows are dropped."""
    rows = raw.select(F.trim("symbol").alias("symbol"), "context", F.expr("try_cast(level AS double)").alias("level")).where("level > 0")
    return rows.join(symbols.select("symbol", "id"), "symbol").select("id", "context", "level").dropna()


def build_report(source_rows: int, rows: DataFrame, entity: str, mapped: str) -> DataFrame:
    """Counts and coverage of one ingest, checked against their invariants."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("valid_records"), F.count(mapped).alias("mapped_records"), F.countDistinct(entity).alias("unique_entities"),
        F.countDistinct(F.when(F.col(mapped).isNotNull(), F.col(entity))).alias("mapped_entities"))
    out = counts.withColumns({
        "source_records": F.lit(source_rows), "unmapped_records": F.col("valid_records") - F.col("mapped_records"),
        "unmapped_entities": F.col("unique_entities") - F.col("mapped_entities"),
        "coverage": F.coalesce(F.try_divide(F.col("mapped_entities").cast("double"), F.col("unique_entities")), F.lit(0.0))})
    return check_report(out)


def check_report(report: DataFrame) -> DataFrame:
    """The report with ``is_consistent``: totals add up, nothing is negative, coverage fits."""
    c = F.col
    numbers = [n for n in report.columns if n.endswith(("_records", "_entities"))]
    sound = (
        (c("mapped_records") + c("unmapped_records") == c("valid_records")) & (c("valid_records") <= c("source_records"))
        & (c("mapped_entities") + c("unmapped_entities") == c("unique_entities")) & c("coverage").between(0.0, 1.0)
        & (F.abs(c("coverage") - F.coalesce(F.try_divide(c("mapped_entities").cast("double"), c("unique_entities")), F.lit(0.0))) <= 1e-12))
    for n in numbers:
        sound = sound & (c(n) >= 0)
    return report.withColumn("is_consistent", sound)
