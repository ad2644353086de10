"""Source readers, payloads, upserts, fingerprints and expiry over the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshflux.session import checkpoint_root
from meshflux.sources import ingest as ig
from meshflux.sources import stores as st
from workloads import evidence as ev
from workloads import inputs as i
from workloads.registry import workload


def r(name, digits):
    return F.round(name, digits).alias(name)


def fresh_path(t, name: str) -> str:
    import uuid

    return f"{checkpoint_root(t.spark)}/files/{name}-{uuid.uuid4().hex}"


#: Sold rows whose pairs share a file; a task sorts and writes one file, and reads it whole.
ROWS_PER_FILE = 250_000


@workload("link_file", f"""WITH {ev.SQL_CHANNELS} SELECT src, dst, combined_score, round(s_nontext, 8) AS s_nontext FROM idx""")
def link_file(t):
    """Channel rows written as the space-delimited file, read back with its header check, and indexed."""
    from meshflux.operators.evidence import CHANNELS, channel_index

    path = fresh_path(t, "links")
    rows = ev.with_decoys(t).select(
        F.concat(F.lit("9606."), "src").alias("protein1"), F.concat(F.lit("9606."), "dst").alias("protein2"), *CHANNELS, "combined_score", "line_no")
    # Both rows of a pair go to one file, the one that must lose first. There are no more pairs than sold rows.
    files = max(3, -(-t.lineitem.count() // ROWS_PER_FILE))
    filed = rows.repartition(files, F.least("protein1", "protein2"), F.greatest("protein1", "protein2")).sortWithinPartitions("line_no").drop("line_no")
    filed.write.option("sep", " ").option("header", True).option("compression", "gzip").csv(path)
    return channel_index(ig.read_links(t.spark, path), threshold=600).select("src", "dst", "combined_score", r("s_nontext", 8))


def expression_raw(t):
    gene = F.when(F.col("l_partkey") % 50 == 0, F.concat(F.lit("BAD"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("ENSG"), F.col("l_partkey").cast("string")))
    level = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_quantity").cast("string"))
    return t.lineitem.select(F.concat(F.lit(" "), gene).alias("Gene"), F.concat(F.lower("l_returnflag"), F.lit(" flag")).alias("Tissue"), level.alias("TPM"))


def gene_map(t):
    return ig.unique_map(t.part.where("p_size > 5").select(F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string")).alias("k"), i.part_id("p_partkey").alias("v")), "k", "v", reject_duplicates=True)


SQL_EXPR = """ok AS (SELECT l_partkey, l_returnflag, max(l_quantity) AS level FROM lineitem WHERE l_partkey % 50 <> 0 AND l_linenumber <> 7 GROUP BY 1, 2)"""


@workload("expression_levels", f"""WITH {SQL_EXPR} SELECT 'P' || l_partkey AS id, l_returnflag || ' Flag' AS context, level FROM ok JOIN part ON p_partkey = l_partkey WHERE p_size > 5""")
def expression_levels(t):
    return ig.expression_levels(expression_raw(t), gene_map(t))[0]


@workload("build_report", f"""WITH {SQL_EXPR}, j AS (SELECT ok.*, p_size > 5 AS m FROM ok JOIN part ON p_partkey = l_partkey)
SELECT (SELECT count(*) FROM lineitem) AS source_records, count(*) AS valid_records, count(*) FILTER (WHERE m) AS mapped_records, count(*) FILTER (WHERE NOT m) AS unmapped_records, count(DISTINCT l_partkey) AS unique_entities,
 round(count(DISTINCT l_partkey) FILTER (WHERE m) / count(DISTINCT l_partkey), 8) AS coverage, true AS is_consistent FROM j""")
def build_report(t):
    report = ig.expression_levels(expression_raw(t), gene_map(t))[1]
    return report.select("source_records", "valid_records", "mapped_records", "unmapped_records", "unique_entities", r("coverage", 8), "is_consistent")


def regulator_raw(t):
    relation = F.when(F.col("l_returnflag") == "R", "Activation").when(F.col("l_returnflag") == "A", "Repression").otherwise("Unknown")
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), i.supplier_id().alias("regulator"), i.part_id().alias("target"), relation.alias("relation"), F.lit(None).cast("string").alias("reference"))


def id_map(t):
    ids = t.part.where("p_size > 20").select(i.part_id("p_partkey").alias("k"), F.concat(F.lit("X"), F.col("p_partkey").cast("string")).alias("v")).unionByName(
        t.supplier.select(i.supplier_id("s_suppkey").alias("k"), F.concat(F.lit("Y"), F.col("s_suppkey").cast("string")).alias("v")))
    return ig.unique_map(ids, "k", "v")


@workload("regulator_tables", """SELECT 'forward' AS tbl, count(*) AS rows FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'inverse', count(*) FROM lineitem
UNION ALL SELECT 'canonical', count(*) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 20""")
def regulator_tables(t):
    tables = ig.regulator_tables(regulator_raw(t), id_map(t))
    out = None
    for name, table in zip(("forward", "inverse", "canonical"), tables):
        part = table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@workload("regulator_overlay", """SELECT 'S' || l_suppkey AS source, 'P' || l_partkey AS target, CASE l_returnflag WHEN 'R' THEN 'consensus_stimulation' WHEN 'A' THEN 'consensus_inhibition' ELSE 'direction_only' END AS evidence_status, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def regulator_overlay(t):
    overlay = ig.regulator_overlay(ig.regulator_tables(regulator_raw(t), id_map(t))[1])
    return overlay.groupBy("source", "target", "evidence_status").agg(F.count(F.lit(1)).alias("n"))


def signalling_raw(t):
    yes = lambda c: F.when(c, "True").otherwise("0")
    return t.lineitem.select(
        F.lit("x").alias("source"), F.lit("y").alias("target"), i.supplier_id().alias("source_genesymbol"), i.part_id().alias("target_genesymbol"),
        yes(F.col("l_linenumber") < 6).alias("is_directed"), yes(F.col("l_returnflag") == "R").alias("is_stimulation"), yes(F.col("l_linestatus") == "O").alias("is_inhibition"),
        yes(F.col("l_linenumber") % 2 == 1).alias("consensus_direction"), yes(F.col("l_tax") > 0.05).alias("consensus_stimulation"), yes(F.col("l_discount") > 0.07).alias("consensus_inhibition"),
        F.concat("l_returnflag", F.lit(";"), "l_linestatus", F.lit("|"), "l_returnflag").alias("sources"), F.concat(F.lit("ref"), F.col("l_linenumber").cast("string")).alias("references"),
        F.col("l_linenumber").cast("string").alias("curation_effort"))


def signalling_file(t):
    """Rows with unmapped ends, loops, complexes, blank ids, and consensus flags that differ from the raw ones or are missing."""
    missing = F.col("l_linenumber") == 3
    raw = signalling_raw(t).columns
    yes = lambda c: F.when(missing, None).when(c, "yes").otherwise("0")
    own = {
        "source": F.concat(F.when(F.col("l_suppkey") % 10 == 0, "COMPLEX:").otherwise(""), F.lit("U"), F.col("l_suppkey").cast("string")),
        "target": F.when(F.col("l_partkey") % 13 == 0, " ").otherwise(F.concat(F.lit("V"), F.col("l_partkey").cast("string"))),
        "source_genesymbol": F.concat(F.when(F.col("l_suppkey") % 7 == 0, "Q").otherwise("S"), F.col("l_suppkey").cast("string")),
        "consensus_stimulation": yes(F.col("l_tax") > 0.05), "consensus_inhibition": yes(F.col("l_discount") > 0.07)}
    own["target_genesymbol"] = F.when(F.col("l_partkey") % 17 == 0, own["source_genesymbol"]).otherwise(i.part_id())
    lines = ig.numbered_rows(t.lineitem)
    plain = {"is_directed": F.when(F.col("l_linenumber") < 6, "True").otherwise("0"), "is_stimulation": F.when(F.col("l_returnflag") == "R", "1").otherwise("0"), "is_inhibition": F.when(F.col("l_linestatus") == "O", "1").otherwise("0"),
             "consensus_direction": F.when(F.col("l_linenumber") % 2 == 1, "y").otherwise("n"), "sources": F.concat("l_returnflag", F.lit(";"), "l_linestatus", F.lit("|"), "l_returnflag"),
             "references": F.concat(F.lit("ref"), F.col("l_linenumber").cast("string")), "curation_effort": F.col("l_linenumber").cast("string")}
    return lines.select(*[(own | plain)[c].alias(c) for c in raw], "row_number")


SQL_SIGNALLING = """f AS (SELECT l_suppkey AS sk, l_partkey AS pk, l_linenumber < 6 AS directed, l_partkey % 13 <> 0 AS named, l_suppkey % 10 = 0 AS complex,
 CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'Y' || l_suppkey END AS sn, CASE WHEN l_partkey % 17 = 0 THEN (CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'Y' || l_suppkey END) WHEN p_size > 20 THEN 'X' || l_partkey END AS tn,
 CASE WHEN l_linenumber = 3 THEN l_returnflag = 'R' ELSE l_tax > 0.05 END AS up, CASE WHEN l_linenumber = 3 THEN l_linestatus = 'O' ELSE l_discount > 0.07 END AS down,
 l_linenumber <> 3 AND l_tax > 0.05 AS cs, l_linenumber <> 3 AND l_discount > 0.07 AS ci, l_linenumber % 2 = 1 AS cd, l_returnflag AS r1, l_linestatus AS r2, l_linenumber AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
x AS (SELECT *, coalesce(sn, 'omnipath:' || CASE WHEN complex THEN 'COMPLEX:' ELSE '' END || 'U' || sk) AS src, coalesce(tn, 'omnipath:V' || pk) AS dst FROM f)"""


@workload("signalling_edges", f"""WITH {SQL_SIGNALLING}
SELECT src, dst, CASE WHEN bool_or(up) AND bool_or(down) THEN 'conflicting' WHEN bool_or(up) THEN 'activation' WHEN bool_or(down) THEN 'inhibition' ELSE 'unsigned' END AS status,
 bool_or(cd) AS consensus_direction, bool_or(cs) AS consensus_stimulation, bool_or(ci) AS consensus_inhibition, sum(n) AS effort, count(*) AS raw_rows, src = dst AS is_loop, bool_or(sn IS NOT NULL) AS src_mapped, bool_or(tn IS NOT NULL) AS dst_mapped,
 array_to_string(list_sort(list_distinct(list_concat(list(r1), list(r2)))), ';') AS resources, array_to_string(list_sort(list_distinct(list('ref' || n))), ';') AS refs FROM x WHERE directed AND named GROUP BY src, dst""")
def signalling_edges(t):
    edges, _ = ig.signalling_edges(signalling_file(t), id_map(t))
    return edges.select("src", "dst", "status", "consensus_direction", "consensus_stimulation", "consensus_inhibition", "effort", "raw_rows", (F.col("src") == F.col("dst")).alias("is_loop"),
                        "src_mapped", "dst_mapped", F.array_join("resources", ";").alias("resources"), F.array_join("refs", ";").alias("refs"))


@workload("signalling_nodes", f"""WITH {SQL_SIGNALLING}, e AS (SELECT src AS id, sn AS m, CASE WHEN complex THEN 'COMPLEX:' ELSE '' END || 'U' || sk AS identifier FROM x UNION ALL SELECT dst, tn, 'V' || pk FROM x WHERE named)
SELECT id, min(identifier) AS identifier, CASE WHEN bool_or(m IS NOT NULL) THEN 'both layers' ELSE 'signalling only' END AS membership FROM e GROUP BY id""")
def signalling_nodes(t):
    return ig.signalling_nodes(ig.signalling_rows(signalling_file(t), id_map(t))).select("id", "identifier", "membership")


@workload("signalling_row_numbers", "SELECT count(*) AS rows, 2 AS first_row, count(*) + 1 AS last_row, count(*) AS distinct_rows FROM lineitem")
def signalling_row_numbers(t):
    return ig.signalling_rows(signalling_file(t), id_map(t)).agg(
        F.count(F.lit(1)).alias("rows"), F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"), F.countDistinct("row_number").alias("distinct_rows"))


@workload("mapping_report", f"""WITH {SQL_SIGNALLING},
e AS (SELECT DISTINCT CASE WHEN complex THEN 'COMPLEX:' ELSE '' END || 'U' || sk AS i, CASE WHEN sk % 7 = 0 THEN 'Q' ELSE 'S' END || sk AS n, sn AS m, complex AS c FROM x
 UNION SELECT DISTINCT 'V' || pk, CASE WHEN pk % 17 = 0 THEN CASE WHEN sk % 7 = 0 THEN 'Q' ELSE 'S' END || sk ELSE 'P' || pk END, tn, false FROM x WHERE named),
a AS (SELECT count(*) AS entities, count(m) AS mapped_entities, count(m) / count(*)::DOUBLE AS er, count(*) FILTER (NOT c AND m IS NOT NULL) / count(*) FILTER (NOT c)::DOUBLE AS ar FROM e),
u AS (SELECT *, directed AND named AS usable FROM x),
b AS (SELECT count(*) AS rows, count(*) FILTER (usable AND sn IS NOT NULL AND tn IS NOT NULL) AS full_, count(*) FILTER (usable AND (sn IS NULL) <> (tn IS NULL)) AS partly_mapped,
 count(*) FILTER (usable AND sn IS NULL AND tn IS NULL) AS signalling_only, count(*) FILTER (directed AND NOT named) AS unusable,
 count(*) FILTER (usable AND NOT complex AND sn IS NOT NULL AND tn IS NOT NULL) / count(*) FILTER (usable AND NOT complex)::DOUBLE AS ae FROM u)
SELECT rows, entities, mapped_entities, full_ AS fully_mapped, partly_mapped, signalling_only, unusable, round(full_ / rows::DOUBLE, 8) AS edge_rate, round(er, 8) AS entity_rate, round(ar, 8) AS atomic_entity_rate, round(ae, 8) AS atomic_edge_rate,
 CASE WHEN full_ / rows::DOUBLE < 0.7 THEN 'FAILURE' WHEN er < 0.9 OR full_ / rows::DOUBLE < 0.85 THEN 'WARNING' ELSE 'PREFERRED' END AS acceptance FROM a, b""")
def mapping_report(t):
    report = ig.signalling_edges(signalling_file(t), id_map(t))[1]
    return report.select("rows", "entities", "mapped_entities", "fully_mapped", "partly_mapped", "signalling_only", "unusable", *[r(c, 8) for c in ("edge_rate", "entity_rate", "atomic_entity_rate", "atomic_edge_rate")], "acceptance")


@workload("directed_overlay", """SELECT 'S' || l_suppkey AS source, 'P' || l_partkey AS target, CASE WHEN l_linenumber % 2 = 1 THEN 'source_to_target' END AS direction, l_returnflag = 'R' AS stimulation, l_linestatus = 'O' AS inhibition,
 CASE WHEN l_tax > 0.05 AND l_discount > 0.07 THEN 'conflicting_evidence' WHEN l_tax > 0.05 THEN 'consensus_stimulation' WHEN l_discount > 0.07 THEN 'consensus_inhibition' WHEN l_linenumber % 2 = 1 THEN 'direction_only' ELSE 'unsupported_direction' END AS evidence_status,
 CASE WHEN l_returnflag < l_linestatus THEN l_returnflag || ';' || l_linestatus ELSE l_linestatus || ';' || l_returnflag END AS provenance, 'ref' || l_linenumber AS "references",
 'Homo sapiens' AS organism, 'r7' AS snapshot_version, 'directed_regulatory' AS evidence_layer, count(*) AS n FROM lineitem GROUP BY ALL""")
def directed_overlay(t):
    """The status rests on the consensus flags, which differ from the raw ones here."""
    overlay, _ = ig.directed_overlay(t.spark, signalling_raw(t), version="r7")
    columns = ["source", "target", "direction", "stimulation", "inhibition", "evidence_status", "provenance", "references", "organism", "snapshot_version", "evidence_layer"]
    return overlay.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def complex_raw(t):
    """One record per order and supplier nation parity, its parts as a ``;`` list."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(i.part_id())), ";").alias("subunits"))  # an order has at most a few lines
    return rows.select(F.col("l_orderkey").cast("string").alias("ComplexID"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("ComplexName"),
                       F.when(F.col("l_orderkey") % 4 == 0, "Mouse").otherwise("Human").alias("Organism"), F.concat(F.lit("None; "), "subunits", F.lit(";;")).alias("subunits"))


@workload("complex_members", """SELECT CAST(l_orderkey AS VARCHAR) AS complex, 'P' || l_partkey AS symbol, CASE WHEN any_value(p_size) > 20 THEN 'X' || l_partkey END AS id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey, l_partkey""")
def complex_members(t):
    return ig.complex_members(complex_raw(t), id_map(t))[0].select("complex", "symbol", "id")


@workload("second_species", """WITH p AS (SELECT l_partkey, l_suppkey, least(1000, 10 * sum(l_quantity)) AS s FROM lineitem GROUP BY 1, 2) SELECT 'edges' AS tbl, count(*) AS rows FROM p WHERE s >= 500
UNION ALL SELECT 'levels', count(*) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 20 AND l_linenumber <> 7""")
def second_species(t):
    edges = ig.second_species_edges(i.interactions(t).withColumnRenamed("score", "combined_score"))
    raw = t.lineitem.select(i.part_id().alias("symbol"), F.col("l_returnflag").alias("context"), F.when(F.col("l_linenumber") == 7, "-").otherwise(F.col("l_quantity").cast("string")).alias("level"))
    levels = ig.second_species_levels(raw, id_map(t).select(F.col("key").alias("symbol"), F.col("value").alias("id")))
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("tbl"), "rows")
    return count(edges, "edges").unionByName(count(levels, "levels"))


# --- payloads ----------------------------------------------------------------

def disease_payloads(t):
    """One nested record per nation with its suppliers as associated targets."""
    links = t.supplier.groupBy("s_nationkey").agg(F.collect_list(F.struct(  # suppliers of one nation, a bounded master table
        (F.col("s_acctbal") / 10000).alias("score"), F.array(F.struct(F.lit("literature").alias("id"), (F.col("s_acctbal") / 20000).alias("score"))).alias("datatypeScores"),
        F.struct(i.supplier_id("s_suppkey").alias("id"), F.col("s_name").alias("approvedSymbol"), F.lit("n").alias("approvedName")).alias("target"))).alias("rows"))
    rows = t.nation.join(links, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    key = F.col("n_nationkey").cast("string")
    return rows.select(F.to_json(F.struct(
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("MONDO_"), key)).otherwise(F.concat(F.lit("EFO_"), key)).alias("id"), F.col("n_name").alias("name"),
        F.array(F.struct(F.lit("exact").alias("relation"), F.array("n_name", F.lower("n_name"), F.lit(" ")).alias("terms"))).alias("synonyms"),
        F.array(F.concat(F.lit("mondo:9"), key)).alias("dbXRefs"), F.array(F.struct(F.lit("root").alias("id"), F.lit(None).cast("string").alias("name"))).alias("parents"),
        F.struct("rows").alias("associatedTargets"))).alias("payload"))


@workload("disease_payloads", """SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'MONDO_' ELSE 'EFO_' END || n_nationkey AS disease_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'MONDO:' || n_nationkey ELSE 'MONDO:9' || n_nationkey END AS ontology_id, 'root' AS parents FROM nation""")
def disease_payload_rows(t):
    return st.parse_diseases(disease_payloads(t))[0].withColumn("parents", F.array_join("parents", ";"))


@workload("disease_associations", """SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'MONDO_' ELSE 'EFO_' END || s_nationkey AS disease_id, 'S' || s_suppkey AS target_id, s_name AS symbol, round(s_acctbal / 10000, 8) AS score, round(s_acctbal / 20000, 8) AS literature FROM supplier""")
def disease_associations(t):
    links = st.parse_diseases(disease_payloads(t))[2]
    return st.ordered_associations(links).select("disease_id", "target_id", "symbol", r("score", 8), F.round(F.col("evidence")["literature"], 8).alias("literature"))


@workload("disease_synonyms", """SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'MONDO_' ELSE 'EFO_' END || n_nationkey AS disease_id, unnest([n_name, lower(n_name)]) AS synonym FROM nation""")
def disease_synonyms(t):
    return st.parse_diseases(disease_payloads(t))[1]


@workload("replace_by_key", """SELECT p_brand AS key, p_partkey AS v, 'old' AS version FROM part WHERE p_brand NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 50) UNION ALL SELECT p_brand, p_partkey, 'new' FROM part WHERE p_size = 50""")
def replace_by_key(t):
    old = t.part.select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("v"), F.lit("old").alias("version"))
    new = t.part.where("p_size = 50").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("v"), F.lit("new").alias("version"))
    return st.replace_by_key(old, new, "key")


@workload("annotation_payloads", """SELECT 'P' || p_partkey AS entity, 'catalogue' AS source, 'T' || p_size AS term, p_type AS kind FROM part WHERE p_size > 3""")
def annotation_payloads(t):
    result = F.struct(F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    payloads = t.part.select(F.to_json(F.struct(i.part_id("p_partkey").alias("entity"), F.lit("1").alias("version"),
                                                F.when(F.col("p_size") > 3, F.array(result, result)).otherwise(F.array().cast("array<struct<id: string, name: string, type: string>>")).alias("results"))).alias("payload"))
    return st.parse_annotations(payloads, source="catalogue").select("entity", "source", "term", "kind")


@workload("json_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_properties(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def publication_payloads(t):
    one = F.struct(F.concat(F.lit("D"), (F.col("doc_id") % 800).cast("string")).alias("publication_id"), F.col("doc_id").cast("string").alias("pmid"),
                   F.substring_index("text", " ", 5).alias("title"), F.lit(2000).alias("year"), F.array(F.concat(F.lit("G"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("G"), (F.col("doc_id") % 11).cast("string"))).alias("genes"))
    return t.documents.select(F.to_json(F.array(one)).alias("payload"))


@workload("publication_payloads", "SELECT DISTINCT 'D' || (doc_id % 800) AS publication_id, 2000 AS year FROM documents")
def publication_rows(t):
    return st.parse_publications(publication_payloads(t)).select("publication_id", "year")


@workload("co_mentions", """WITH g AS (SELECT DISTINCT 'D' || doc_id AS id, unnest(['G' || (doc_id % 7), 'G' || (doc_id % 11)]) AS g FROM documents)
SELECT id AS publication_id, CASE WHEN bool_or(g = 'G3') AND bool_or(g = 'G5') THEN 'co_mention' WHEN bool_or(g = 'G3') THEN 'target_only' ELSE 'response_only' END AS label FROM g WHERE g IN ('G3', 'G5') GROUP BY id""")
def co_mentions(t):
    genes = F.array(*[F.concat(F.lit("G"), (F.col("doc_id") % k).cast("string")) for k in (7, 11)])
    pubs = t.documents.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("publication_id"), genes.alias("genes"))
    return st.co_mentions(pubs, t.spark.createDataFrame([("G3", "target"), ("G5", "response")], "gene string, side string"))


@workload("merge_publications", """WITH RECURSIVE x AS (SELECT doc_id AS id, 'u' || doc_id AS a, CASE WHEN doc_id % 3 = 0 THEN doc_id // 6 END AS p, CASE WHEN doc_id % 2 = 0 THEN doc_id // 10 END AS d FROM documents),
l AS (SELECT x.id AS s, y.id AS t FROM x JOIN (SELECT p, min(id) AS id FROM x WHERE p IS NOT NULL GROUP BY p) y USING (p) UNION SELECT x.id, y.id FROM x JOIN (SELECT d, min(id) AS id FROM x WHERE d IS NOT NULL GROUP BY d) y USING (d)),
ar AS MATERIALIZED (SELECT s, t FROM l UNION SELECT t, s FROM l UNION SELECT id, id FROM x),
c AS (SELECT id, id AS label, 0 AS k FROM x UNION ALL SELECT ar.t, min(c.label), c.k + 1 FROM c JOIN ar ON ar.s = c.id WHERE c.k < 30 GROUP BY ar.t, c.k)
SELECT label AS row_id, count(*) AS merged_rows FROM c WHERE k = 30 GROUP BY label""")
def merge_publications(t):
    rows = t.documents.select(
        F.col("doc_id").alias("row_id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("publication_id"),
        F.when(F.col("doc_id") % 3 == 0, F.floor(F.col("doc_id") / 6)).alias("pmid"), F.lit(None).cast("string").alias("pmcid"), F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("doc_id") / 10)).alias("doi"))
    return st.merge_publications(rows).select("row_id", "merged_rows")


# --- stores ------------------------------------------------------------------

@workload("persisted_edges", f"WITH {i.sql_edges()} SELECT src, dst, score FROM edges")
def persisted_edges(t):
    path = fresh_path(t, "edges")
    edges = i.plain_graph(t).select("src", "dst", "score")
    st.write_edges(edges, path, fingerprint="v1")
    return st.read_edges(t.spark, path, fingerprint="v1")


@workload("csv_export", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, 'run' AS label, '1' AS version FROM supplier")
def csv_export(t):
    path = fresh_path(t, "export")
    st.export_csv(t.supplier.select("s_suppkey", "s_name"), path, metadata={"label": "run", "version": 1})
    return t.spark.read.csv(path, header=True)


@workload("provenance_column", """SELECT s_suppkey, '{"seed":42,"source":"sales"}' AS provenance FROM supplier""")
def provenance_column(t):
    return st.with_provenance(t.supplier.select("s_suppkey"), {"source": "sales", "seed": 42})


@workload("fingerprints", f"""WITH {i.sql_edges()}, c AS (SELECT (SELECT count(*) FROM edges) + (SELECT count(DISTINCT src) FROM arcs) AS rows)
SELECT variant, rows + more AS rows, same FROM c, (VALUES ('flipped', 0, true), ('isolated', 1, false), ('weight', 0, false)) v(variant, more, same)""")
def fingerprints(t):
    """Order and direction of the input do not change the digest; another node, or a weight changed in its last digits, does."""
    edges = i.plain_graph(t).select("src", "dst", "weight", "distance", F.lit(False).alias("is_bridge"))
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "distance", "is_bridge").repartition(5, "src")
    alone = t.spark.createDataFrame([("alone",)], "id string")
    least = edges.agg(F.min(F.struct("src", "dst"))).first()[0]
    moved = edges.withColumn("weight", F.when((F.col("src") == least.src) & (F.col("dst") == least.dst), F.col("weight") * (1 + 1e-14)).otherwise(F.col("weight")))
    base = st.graph_fingerprint(edges).select(F.col("fingerprint").alias("base"))
    out = None
    for name, found in (("flipped", st.graph_fingerprint(flipped)), ("isolated", st.graph_fingerprint(edges, alone)), ("weight", st.graph_fingerprint(moved))):
        part = found.withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(base)).select("variant", "rows", (F.col("fingerprint") == F.col("base")).alias("same"))  # one row


@workload("schema_health", """SELECT * FROM (
 SELECT 'part' AS dataset, true AS required, true AS present, '' AS missing, 'READY' AS status, (SELECT count(*) FROM part) AS rows, (SELECT count(*) FROM part WHERE p_partkey IS NULL OR p_name IS NULL) AS incomplete
 UNION ALL SELECT 'supplier', false, true, 's_rating', 'PARTIAL', (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier WHERE s_suppkey IS NULL)
 UNION ALL SELECT 'reviewed', true, true, '', 'READY', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_totalprice < 100000)
 UNION ALL SELECT 'extra', true, false, 'a;b', 'UNAVAILABLE', NULL, NULL)""")
def schema_health(t):
    declared = {"part": (("p_partkey", "p_name"), True), "supplier": (("s_suppkey", "s_rating"), False), "reviewed": (("o_orderkey", "price"), True), "extra": (("a", "b"), True)}
    reviewed = t.orders.select("o_orderkey", F.when(F.col("o_totalprice") >= 100000, F.col("o_totalprice")).alias("price"))
    tables = {"part": t.part, "supplier": t.supplier, "reviewed": reviewed, "extra": None}
    rows = st.inspect_rows({k: v for k, v in tables.items() if v is not None}, declared)
    return st.inspect_schema(tables, declared, t.spark).join(rows, "dataset", "left")


@workload("overall_status", """SELECT 'UNAVAILABLE' AS status, 'PARTIAL' AS without_extra, count(*) AS datasets FROM (SELECT DISTINCT o_orderstatus FROM orders)""")
def overall_status(t):
    """The worst status decides; datasets are the orders by their status."""
    names = [row[0] for row in t.orders.select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()]  # three
    parts = {n: t.orders.where(F.col("o_orderstatus") == n) for n in names}
    declared = {n: (("o_orderkey", "rating") if n == names[0] else ("o_orderkey",), False) for n in names}
    whole = st.overall_status(st.inspect_schema({**parts, "extra": None}, {**declared, "extra": (("a",), True)}, t.spark))
    some = st.overall_status(st.inspect_schema(parts, declared, t.spark)).withColumnRenamed("status", "without_extra")
    counted = t.orders.agg(F.countDistinct("o_orderstatus").alias("datasets"))
    return whole.join(F.broadcast(some)).join(F.broadcast(counted))  # one row each


@workload("live_results", """WITH x AS (SELECT user_id, event_type, ts, event_id, CASE event_type WHEN 'error' THEN 21600 WHEN 'click' THEN 604800 WHEN 'view' THEN 1209600 ELSE 2592000 END AS ttl FROM events)
SELECT user_id, event_type, max(ts) AS latest FROM x WHERE ts + to_seconds(ttl) > (SELECT max(ts) FROM events) GROUP BY 1, 2""")
def live_results(t):
    now = t.events.agg(F.max("ts")).first()[0]
    rows = t.events.select(
        "user_id", "event_type", F.col("ts").alias("retrieved_at"), F.when(F.col("event_type") == "error", "NO_MATCH").otherwise("AVAILABLE").alias("status"),
        F.when(F.col("event_type") == "click", "literature").when(F.col("event_type") == "view", "pathway_annotation").otherwise("entity_resolution").alias("evidence_class"))
    return st.live_results(rows, F.lit(now), ["user_id", "event_type"]).select("user_id", "event_type", F.col("retrieved_at").alias("latest"))
