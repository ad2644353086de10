"""Labels, lookups and membership joins on result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keyword and location label.
LOCATION_RULES = (
    ("nucleus", "Nucleus"),
    ("nucleol", "Nucleus"),
    ("nuclear", "Nucleus"),
    ("chromatin", "Nucleus"),
    ("chromosome", "Nucleus"),
    ("nuclear envelope", "Nucleus"),
    ("nuclear pore", "Nucleus"),
    ("mitochondri", "Mitochondrion"),
    ("endoplasmic reticulum", "Endoplasmic_Reticulum"),
    ("er lumen", "Endoplasmic_Reticulum"),
    ("er membrane", "Endoplasmic_Reticulum"),
    ("sarcoplasmic reticulum", "Endoplasmic_Reticulum"),
    ("golgi", "Golgi_Apparatus"),
    ("trans-golgi", "Golgi_Apparatus"),
    ("cis-golgi", "Golgi_Apparatus"),
    ("plasma membrane", "Cell_Membrane"),
    ("cell surface", "Cell_Membrane"),
    ("cell periphery", "Cell_Membrane"),
    ("basolateral plasma membrane", "Cell_Membrane"),
    ("apical plasma membrane", "Cell_Membrane"),
    ("integral component of plasma membrane", "Cell_Membrane"),
    ("intrinsic component of plasma membrane", "Cell_Membrane"),
    ("extracellular", "Extracellular"),
    ("secreted", "Extracellular"),
    ("collagen", "Extracellular"),
    ("extracellular matrix", "Extracellular"),
    ("extracellular space", "Extracellular"),
    ("lysosom", "Lysosome_Endosome"),
    ("endosom", "Lysosome_Endosome"),
    ("vacuol", "Lysosome_Endosome"),
    ("phagosom", "Lysosome_Endosome"),
    ("autophagosom", "Lysosome_Endosome"),
    ("cytoplasm", "Cytoplasm"),
    ("cytosol", "Cytoplasm"),
    ("cytoskeleton", "Cytoplasm"),
    ("ribosom", "Cytoplasm"),
    ("proteasom", "Cytoplasm"),
    ("peroxisom", "Peroxisome"),
)

# Keyword and function class; within a term the first rule wins.
FUNCTION_RULES = (
    ("channel", "Ion_Channel"),
    ("transporter", "Ion_Channel"),
    ("transcription", "Transcription_Factor"),
    ("dna binding", "Transcription_Factor"),
    ("kinase", "Kinase"),
    ("receptor", "Receptor"),
    ("structural", "Structural"),
    ("cytoskeleton", "Structural"),
    ("enzyme", "Enzyme"),
    ("catalytic", "Enzyme"),
    ("ligand", "Signaling"),
    ("hormone", "Signaling"),
    ("rna", "RNA_Binding"),
    ("ubiquitin", "Ubiquitin_Related"),
)

# Symbol family and its pattern.
FAMILY_RULES = (
    ("ANO", r"(?i)^ANO\d"),
    ("AQP", r"(?i)^AQP\d"),
    ("SLC4", r"(?i)^SLC4"),
    ("SLC9", r"(?i)^SLC9"),
    ("SLC13", r"(?i)^SLC13"),
    ("SLC26", r"(?i)^SLC26"),
    ("LRRC8", r"(?i)^LRRC8"),
    ("CLCN", r"(?i)^CLCN"),
    ("BEST", r"(?i)^BEST\d"),
    ("CA", r"(?i)^CA\d"),
)


def _contains_any(words: Sequence[str]):
    """Test of one text for any of the words."""
    def test(text):
        out = F.lit(False)
        for word in words:
            out = out | text.contains(word)
        return out

    return test


def all_labels(terms: Column | str, rules: Sequence[tuple[str, str]] = LOCATION_RULES, *, default: str = "Unknown") -> Column:
    """Every label whose keyword occurs in any term, sorted and joined by `` | ``."""
    t = F.col(terms) if isinstance(terms, str) else terms
    lowered = F.transform(t, F.lower)
    keywords: dict[str, list[str]] = {}
    for word, label in rules:
        keywords.setdefault(label, []).append(word)
    found = []
    for label in sorted(keywords):
        found.append(F.when(F.exists(lowered, _contains_any(keywords[label])), F.lit(label)))
    joined = F.array_join(F.array_compact(F.array(*found)), " | ")
    return F.when(joined != "", joined).otherwise(default)


def first_label(terms: Column | str, rules: Sequence[tuple[str, str]] = FUNCTION_RULES, *, other: str = "Other", default: str = "Unknown") -> Column:
    """Label of the first term that matches a rule, rules in order within a term."""
    t = F.col(terms) if isinstance(terms, str) else terms

    def label_of(term):
        out = F.lit(None).cast("string")
        for word, label in reversed(rules):
            out = F.when(F.lower(term).contains(word), F.lit(label)).otherwise(out)
        return out

    labels = F.array_compact(F.transform(t, label_of))
    return F.when(F.coalesce(F.size(t), F.lit(0)) <= 0, default).otherwise(F.coalesce(F.get(labels, F.lit(0)), F.lit(other)))


def symbol_families(symbols: DataFrame, rules: Sequence[tuple[str, str]] = FAMILY_RULES, *, minimum: int = 2) -> DataFrame:
    """Members of symbol families with at least ``minimum`` members: ``family, symbol, members``."""
    hits = F.array_compact(F.array(*[F.when(F.col("symbol").rlike(p), F.lit(f)) for f, p in rules]))
    rows = symbols.select("symbol").distinct().select("symbol", F.explode(hits).alias("family"))
    sizes = rows.groupBy("family").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= minimum)
    return rows.join(sizes, "family")


def first_present(*columns: str) -> Column:
    """First column that is neither null nor NaN."""
    return F.coalesce(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in columns])


def first_in_group(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """First non-null value per key, by order."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def project_contract(df: DataFrame, contract: Sequence[tuple[str, str, str]], defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns of a fixed contract ``(output, input, type)``; an absent or null input takes its default."""
    defaults = defaults or {}
    out = []
    for name, source, kind in contract:
        value = F.col(source).cast(kind) if source in df.columns else F.lit(None).cast(kind)
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]).cast(kind))
        out.append(value.alias(name))
    return df.select(*out)


def attach_symbols(df: DataFrame, mapping: DataFrame, *, key: str = "id") -> DataFrame:
    """Add ``symbol`` and ``mapping_status``; an unmapped id keeps its id as symbol."""
    one = mapping.where("symbol IS NOT NULL AND symbol <> ''").groupBy("id").agg(F.min("symbol").alias("_symbol"))
    joined = df.join(one.withColumnRenamed("id", key), key, "left")
    return joined.withColumns({
        "symbol": F.coalesce("_symbol", F.col(key)),
        "mapping_status": F.when(F.col("_symbol").isNull(), "UNRESOLVED").otherwise("MAPPED")}).drop("_symbol")


def attach_locations(df: DataFrame, locations: DataFrame) -> DataFrame:
    return df.join(locations.select("id", "location"), "id", "left").fillna("Unknown", ["location"])


def split_by_presence(df: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is in the graph, and rows whose id is not."""
    ids = vertices.select("id").distinct()
    return df.join(ids, "id", "left_semi"), df.join(ids, "id", "left_anti")


def attach_regulators(df: DataFrame, regulators: DataFrame, *, show: int | None = None) -> DataFrame:
    """Add the regulators of each symbol as text, ``+n more`` beyond ``show``.

    ``regulators(symbol, position, regulator, effect)`` in source order.
    """
    order = Window.partitionBy("symbol").orderBy("position")
    rows = regulators.withColumn("_r", F.row_number().over(order))
    total = regulators.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    shown = rows if show is None else rows.where(F.col("_r") <= show)
    text = F.concat("regulator", F.lit(" ("), "effect", F.lit(")"))
    lists = shown.groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", text.alias("t")))), lambda x: x["t"]), ", ").alias("_list"))
    more = F.lit("") if show is None else F.when(F.col("_n") > show, F.format_string(" +%d more", F.col("_n") - F.lit(show))).otherwise("")
    named = lists.join(total, "symbol").select("symbol", F.concat("_list", more).alias("regulators"))
    return df.join(named, "symbol", "left").fillna("—", ["regulators"])


def attach_essentiality(df: DataFrame, screens: DataFrame, *, minimum: int = 1) -> DataFrame:
    """Add ``hits/tests (percent)`` text for symbols with enough tests."""
    usable = screens.where(F.col("tests") >= minimum).select(
        "symbol", F.format_string("%d/%d (%d%%)", F.col("hits"), F.col("tests"), F.round(F.col("hits") / F.col("tests") * 100).cast("int")).alias("essentiality"))
    return df.join(usable, "symbol", "left").fillna("—", ["essentiality"])


def star_lookup(ids: DataFrame, accessions: DataFrame, structures: DataFrame, bindings: DataFrame) -> DataFrame:
    """Structural scores and binding summary per id through its accession; missing stays null."""
    return ids.join(accessions, "id", "left").join(structures, "accession", "left").join(bindings, "accession", "left")


def bound_structures(accessions: DataFrame, structures: DataFrame, bindings: DataFrame, features: Sequence[str]) -> DataFrame:
    """Ids with complete features and at least one ligand."""
    joined = accessions.join(structures, "accession").join(bindings, "accession")
    return joined.dropna(subset=list(features)).where("num_ligands > 0")


def similar_items(items: DataFrame, target: str, features: Sequence[str], *, top: int = 10) -> DataFrame:
    """Items most similar to a target: ``1 / (1 + distance)`` over min-max scaled features.

    The target is one row, collected as plain numbers; the candidates are one scan.
    """
    spans = items.agg(*[e for f in features for e in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))]).first()
    here = items.where(F.col("id") == target).select(*features).first()
    if here is None:
        return items.select("id", F.lit(0.0).alias("similarity")).where("false")
    squares = F.lit(0.0)
    for f in features:
        width = (spans[f"hi_{f}"] - spans[f"lo_{f}"]) or 1.0
        squares = squares + F.pow((F.col(f) - F.lit(here[f])) / F.lit(width), F.lit(2.0))
    rated = items.where(F.col("id") != target).select("id", (1.0 / (1.0 + F.sqrt(squares))).alias("similarity"))
    return rated.orderBy(F.desc("similarity"), "id").limit(top)


def similar_vectors(items: DataFrame, target: int, *, key: str = "vec_id", vector: str = "embedding", top: int = 10) -> DataFrame:
    """The vector form: similarity over ``array`` features scaled per position."""
    sized = items.select(key, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    span = sized.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ranges = span.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", (F.col("hi") - F.col("lo")).alias("w")))), lambda s: s["w"]).alias("w")).first()["w"]
    here = sized.where(F.col(key) == target).first()["v"]
    scale = F.array(*[F.lit(float(w or 1.0)) for w in ranges])
    origin = F.array(*[F.lit(float(x)) for x in here])
    steps = F.zip_with(F.zip_with("v", origin, lambda a, b: a - b), scale, lambda d, w: (d / w) * (d / w))
    rated = sized.where(F.col(key) != target).select(key, (1.0 / (1.0 + F.sqrt(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)))).alias("similarity"))
    return rated.orderBy(F.desc("similarity"), F.asc(key)).limit(top)


def best_ligands(ligands: DataFrame, *, top: int = 5) -> DataFrame:
    """Strongest binders per accession: least ki, then least ic50, missing last."""
    order = Window.partitionBy("accession").orderBy(F.asc_nulls_last("ki"), F.asc_nulls_last("ic50"), "ligand")
    return ligands.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


# --- id resolution -----------------------------------------------------------

# Stages in order of trust.
STAGES = ("canonical", "project_id", "symbol", "alias", "external")


def resolve(queries: DataFrame, lookup: DataFrame, *, extra: DataFrame | None = None) -> DataFrame:
    """Staged resolution: the first stage with any hit decides, several entities are ambiguous.

    ``queries(query)``, ``lookup(key, stage, entity)``. ``extra`` is an external
    table of the same shape, tried last. Nothing is chosen for an ambiguous query.
    """
    table = lookup if extra is None else lookup.unionByName(extra.withColumn("stage", F.lit("external")))
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    keyed = table.select(F.lower(F.trim("key")).alias("key"), rank.alias("rank"), "stage", "entity").distinct()
    asked = queries.select("query", F.lower(F.trim("query")).alias("key")).distinct()
    hits = asked.join(keyed, "key")
    first = hits.groupBy("query").agg(F.min("rank").alias("rank"))
    found = hits.join(first, ["query", "rank"]).groupBy("query").agg(
        F.countDistinct("entity").alias("candidates"), F.min("entity").alias("entity"), F.min("stage").alias("stage"))
    joined = asked.join(found, "query", "left")
    status = (
        F.when(F.col("candidates").isNull(), "UNRESOLVED").when(F.col("candidates") > 1, "AMBIGUOUS")
        .when(F.col("stage") == "alias", "ALIAS").when(F.col("stage") == "external", "EXTERNAL").otherwise("EXACT"))
    return joined.select(
        "query", status.alias("status"), F.when(F.col("candidates") == 1, F.col("entity")).alias("entity"),
        F.when(F.col("candidates").isNotNull(), F.col("stage")).alias("stage"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def resolve_reference(associations: DataFrame, by_id: DataFrame, by_symbol: DataFrame) -> DataFrame:
    """Reference ids first, symbols only for what remains; every row is mapped, ambiguous or unmapped.

    ``associations(row, ext_id, symbol)``, ``by_id(key, entity)``, ``by_symbol(key, entity)``.
    """
    def look(rows, column, table):
        # A key keeps its least and greatest entity: a row meets one row of each key, however many entities share it.
        ends = table.groupBy(F.lower("key").alias("_k")).agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))
        hits = rows.select("row", F.lower(F.trim(column)).alias("_k")).join(ends, "_k")
        found = hits.groupBy("row").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        n = F.when(F.col("lo").isNull(), 0).when(F.col("lo") == F.col("hi"), 1).otherwise(2)
        return found.select("row", n.alias("n"), F.col("lo").alias("entity"))

    first = look(associations, "ext_id", by_id).withColumnsRenamed({"n": "n1", "entity": "e1"})
    second = look(associations, "symbol", by_symbol).withColumnsRenamed({"n": "n2", "entity": "e2"})
    rows = associations.join(first, "row", "left").join(second, "row", "left")
    n = F.coalesce("n1", "n2")
    status = F.when(n == 1, "mapped").when(n > 1, "ambiguous").otherwise("unmapped")
    return rows.select("row", status.alias("status"), F.when(n == 1, F.when(F.col("n1").isNotNull(), F.col("e1")).otherwise(F.col("e2"))).alias("entity"))


def memberships(identifiers: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups of each identifier through any of its symbols, with the route that matched.

    ``groups(group, approved, previous, aliases)`` with alias arrays.
    """
    def route(values, name):
        return groups.select("group", values.alias("_v"), F.lit(name).alias("route")).select("group", F.upper("_v").alias("symbol"), "route")

    long = route(F.col("approved"), "approved").unionByName(route(F.explode("previous"), "previous")).unionByName(
        route(F.explode("aliases"), "alias"))
    rank = F.array_position(F.array(F.lit("approved"), F.lit("previous"), F.lit("alias")), F.col("route"))
    hits = identifiers.select(F.upper("symbol").alias("symbol")).distinct().join(long.distinct(), "symbol")
    return hits.groupBy("symbol", "group").agg(F.min_by("route", rank).alias("route"))


def touching_relations(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations with a listed symbol at either end, as a union of two equi-joins."""
    ids = symbols.select(F.col("symbol").alias("_s")).distinct()
    left = relations.join(ids, relations["regulator"] == ids["_s"], "left_semi")
    right = relations.join(ids, relations["target"] == ids["_s"], "left_semi")
    return left.unionByName(right).distinct()


def merge_annotations(entities: DataFrame, identifiers: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations of several sources on each entity by any identifier, and entities without one.

    ``identifiers(entity, identifier)``, ``annotations(source, identifier, kind, term)``.
    """
    linked = identifiers.join(entities.select("entity").distinct(), "entity", "left_semi").join(annotations, "identifier")
    merged = linked.select("entity", "source", "kind", "term").distinct()
    return merged, entities.select("entity").distinct().join(merged.select("entity").distinct(), "entity", "left_anti")


def sentinel_check(expected: DataFrame, observed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Status of known entities: direct, by unique symbol, ambiguous or unmapped; PASS or FAIL.

    ``expected(id, symbol, least)``, ``observed(id, importance)``, ``mapping(id, symbol)``.
    """
    direct = observed.select("id", F.col("importance").alias("direct"))
    by_symbol = mapping.join(observed, "id").groupBy("symbol").agg(F.countDistinct("id").alias("n"), F.max("importance").alias("through"))
    rows = expected.join(direct, "id", "left").join(by_symbol, "symbol", "left")
    how = F.when(F.col("direct").isNotNull(), "direct").when(F.col("n") == 1, "unique_symbol").when(F.col("n") > 1, "ambiguous").otherwise("unmapped")
    value = F.when(how == "direct", F.col("direct")).when(how == "unique_symbol", F.col("through"))
    return rows.select("id", "symbol", how.alias("mapping"), value.alias("importance"),
                       F.when(value.isNull(), "NOT_EVALUATED").when(value >= F.col("least"), "PASS").otherwise("FAIL").alias("result"))


def sentinel_summary(checks: DataFrame) -> DataFrame:
    done = F.count_if(F.col("result") != "NOT_EVALUATED")
    passed = F.count_if(F.col("result") == "PASS")
    return checks.agg(
        F.count(F.lit(1)).alias("total"), done.alias("evaluated"), passed.alias("passed"),
        F.try_divide(done.cast("double"), F.count(F.lit(1))).alias("coverage"), F.try_divide(passed.cast("double"), done).alias("success_rate"))
