"""Labels, resolution, selection, comparison, findings and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshflux.functions import text as tx
from meshflux.operators import annotate as an
from meshflux.operators import crosswise as cw
from meshflux.operators import findings as fi
from meshflux.operators import selection as se
from meshflux.session import cut
from workloads import inputs as i
from workloads.registry import workload


def r(name, digits):
    return F.round(name, digits).alias(name)


def responses(t, threshold="1.5"):
    """Response of every part: its discounts around their mean."""
    return t.lineitem.groupBy(i.part_id().alias("id")).agg(F.round(F.sum("l_discount") - F.expr(threshold), 4).alias("delta_pct"), F.sum("l_quantity").alias("importance"))


SQL_RESP = "resp AS MATERIALIZED (SELECT 'P' || l_partkey AS id, round(sum(l_discount) - 1.5, 4) AS delta_pct, sum(l_quantity) AS importance FROM lineitem GROUP BY 1)"


# --- labels ------------------------------------------------------------------

WORDS = (("red", "Warm"), ("small", "Size"), ("large", "Size"), ("blue", "Cold"), ("green", "Cold"), ("steel", "Metal"))


@workload("all_labels", """SELECT p_partkey, coalesce(nullif(concat_ws(' | ', CASE WHEN p_name LIKE '%blue%' OR p_name LIKE '%green%' THEN 'Cold' END, CASE WHEN p_name LIKE '%steel%' THEN 'Metal' END,
 CASE WHEN p_name LIKE '%small%' OR p_name LIKE '%large%' THEN 'Size' END, CASE WHEN p_name LIKE '%red%' THEN 'Warm' END), ''), 'Unknown') AS label FROM part""")
def all_labels(t):
    return t.part.select("p_partkey", an.all_labels(F.split("p_name", " "), WORDS).alias("label"))


@workload("first_label", """SELECT p_partkey, CASE WHEN w1 IS NOT NULL THEN w1 WHEN w2 IS NOT NULL THEN w2 ELSE 'Other' END AS label FROM (
 SELECT p_partkey, CASE WHEN a LIKE '%red%' THEN 'Warm' WHEN a LIKE '%small%' OR a LIKE '%large%' THEN 'Size' WHEN a LIKE '%blue%' OR a LIKE '%green%' THEN 'Cold' WHEN a LIKE '%steel%' THEN 'Metal' END AS w1,
  CASE WHEN b LIKE '%red%' THEN 'Warm' WHEN b LIKE '%small%' OR b LIKE '%large%' THEN 'Size' WHEN b LIKE '%blue%' OR b LIKE '%green%' THEN 'Cold' WHEN b LIKE '%steel%' THEN 'Metal' END AS w2
 FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS a, split_part(p_name, ' ', 1) AS b FROM part))""")
def first_label(t):
    return t.part.select("p_partkey", an.first_label(F.reverse(F.split("p_name", " ")), WORDS).alias("label"))


@workload("location_rules", None)
def location_rules(t):
    """Location and function labels of the documents' words under the fixed rules."""
    words = F.split("text", r"\s+")
    return t.documents.select("doc_id", an.all_labels(words).alias("location"), an.first_label(words).alias("function"))


@workload("symbol_families", """SELECT regexp_extract(p_brand, '^(Brand#[12])', 1) AS family, p_brand AS symbol, count(*) OVER (PARTITION BY regexp_extract(p_brand, '^(Brand#[12])', 1)) AS members FROM (SELECT DISTINCT p_brand FROM part) WHERE regexp_matches(p_brand, '^Brand#[12]')""")
def symbol_families(t):
    rules = (("Brand#1", r"^Brand#1"), ("Brand#2", r"^Brand#2"), ("Brand#9", r"^Brand#9\d"))
    return an.symbol_families(t.part.select(F.col("p_brand").alias("symbol")), rules)


@workload("split_terms", """SELECT p_partkey, p_name || '|' || p_type AS terms, 2 AS n FROM part""")
def split_terms(t):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('["'), "p_name", F.lit('", "n/a", "'), "p_type", F.lit('"]'))).otherwise(
        F.concat("p_name", F.lit(" ; "), "p_type", F.lit("|nan;"), "p_name"))
    terms = tx.split_terms(raw)
    return t.part.select("p_partkey", F.array_join(terms, "|").alias("terms"), F.size(terms).alias("n"))


@workload("attach_symbols", """SELECT 'P' || p_partkey AS id, CASE WHEN p_size > 10 THEN p_brand || p_partkey ELSE 'P' || p_partkey END AS symbol, CASE WHEN p_size > 10 THEN 'MAPPED' ELSE 'UNRESOLVED' END AS mapping_status FROM part""")
def attach_symbols(t):
    mapping = t.part.where("p_size > 10").select(i.part_id("p_partkey").alias("id"), F.concat("p_brand", F.col("p_partkey").cast("string")).alias("symbol"))
    return an.attach_symbols(t.part.select(i.part_id("p_partkey").alias("id")), mapping)


@workload("attach_locations", f"""WITH {i.SQL_LOCATIONS}, x AS (SELECT DISTINCT 'P' || (l_partkey + 100) AS id FROM lineitem)
SELECT x.id, coalesce(location, 'Unknown') AS location FROM x LEFT JOIN locations USING (id)""")
def attach_locations(t):
    ids = t.lineitem.select(F.concat(F.lit("P"), (F.col("l_partkey") + 100).cast("string")).alias("id")).distinct()
    return an.attach_locations(ids, i.part_locations(t))


@workload("ghost_rows", f"""WITH {i.SQL_PAIRS}, v AS (SELECT src AS id FROM pairs WHERE score >= 800 UNION SELECT dst FROM pairs WHERE score >= 800)
SELECT 'P' || p_partkey AS id, 'P' || p_partkey IN (SELECT id FROM v) AS present FROM part""")
def ghost_rows(t):
    graph = i.interactions(t).where("score >= 800")
    vertices = graph.select(F.explode(F.array("src", "dst")).alias("id"))
    here, gone = an.split_by_presence(t.part.select(i.part_id("p_partkey").alias("id")), vertices)
    return here.withColumn("present", F.lit(True)).unionByName(gone.withColumn("present", F.lit(False)))


@workload("attach_regulators", """WITH x AS (SELECT DISTINCT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_partkey, l_suppkey) AS pos FROM lineitem WHERE l_returnflag = 'R'),
k AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY pos) AS r, count(*) OVER (PARTITION BY l_partkey) AS n FROM x),
t AS (SELECT l_partkey, string_agg('S' || l_suppkey || ' (returned)', ', ' ORDER BY r) || CASE WHEN any_value(n) > 3 THEN ' +' || (any_value(n) - 3) || ' more' ELSE '' END AS s FROM k WHERE r <= 3 GROUP BY 1)
SELECT 'P' || p_partkey AS symbol, coalesce(s, '—') AS regulators FROM part LEFT JOIN t ON l_partkey = p_partkey""")
def attach_regulators(t):
    rows = t.lineitem.where("l_returnflag = 'R'").groupBy(i.part_id().alias("symbol"), i.supplier_id().alias("regulator")).agg(
        F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position")).withColumn("effect", F.lit("returned"))
    return an.attach_regulators(t.part.select(i.part_id("p_partkey").alias("symbol")), rows, show=3)


@workload("attach_essentiality", """WITH x AS (SELECT 'P' || l_partkey AS symbol, count(*) AS tests, count(*) FILTER (WHERE l_returnflag = 'R') AS hits FROM lineitem GROUP BY 1)
SELECT 'P' || p_partkey AS symbol, coalesce(CASE WHEN tests >= 25 THEN hits || '/' || tests || ' (' || CAST(round(hits / tests * 100) AS INT) || '%)' END, '—') AS essentiality FROM part LEFT JOIN x ON symbol = 'P' || p_partkey""")
def attach_essentiality(t):
    return an.attach_essentiality(t.part.select(i.part_id("p_partkey").alias("symbol")), screens(t), minimum=25)


def screens(t):
    return t.lineitem.groupBy(i.part_id().alias("symbol")).agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("l_returnflag") == "R").alias("hits"))


@workload("essentiality_validation", """WITH x AS (SELECT 'P' || l_partkey AS symbol, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS h, sum(l_quantity) AS s FROM lineitem GROUP BY 1 HAVING count(*) >= 25),
k AS (SELECT rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0 AS a, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS b FROM x)
SELECT count(*) AS n, round(corr(a, b), 8) AS spearman, CASE WHEN count(*) < 20 THEN 'INSUFFICIENT' ELSE 'COMPLETED' END AS status FROM k""")
def essentiality_validation(t):
    scores = responses(t).select(F.col("id").alias("symbol"), "importance")
    return cw.essentiality_validation(scores, screens(t), minimum_tests=25).withColumn("spearman", F.round("spearman", 8))


@workload("star_lookup", """SELECT 'P' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'S' || (p_partkey % 100) END AS accession, CASE WHEN p_size % 3 = 0 THEN s_acctbal END AS sasa, CASE WHEN p_size % 3 = 0 AND s_nationkey > 10 THEN s_nationkey END AS num_ligands
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 100""")
def star_lookup(t):
    accession = F.concat(F.lit("S"), (F.col("p_partkey") % 100).cast("string"))
    accessions = t.part.where("p_size % 3 = 0").select(i.part_id("p_partkey").alias("id"), accession.alias("accession"))
    structures = t.supplier.select(i.supplier_id("s_suppkey").alias("accession"), F.col("s_acctbal").alias("sasa"))
    bindings = t.supplier.where("s_nationkey > 10").select(i.supplier_id("s_suppkey").alias("accession"), F.col("s_nationkey").alias("num_ligands"))
    out = an.star_lookup(t.part.select(i.part_id("p_partkey").alias("id")), accessions, structures, bindings)
    return out.select("id", "accession", "sasa", "num_ligands")


@workload("bound_structures", """SELECT 'P' || p_partkey AS id, s_acctbal AS sasa, s_nationkey AS num_ligands FROM part JOIN supplier ON s_suppkey = p_partkey % 100 WHERE s_acctbal > 0 AND s_nationkey > 0""")
def bound_structures(t):
    accessions = t.part.select(i.part_id("p_partkey").alias("id"), F.concat(F.lit("S"), (F.col("p_partkey") % 100).cast("string")).alias("accession"))
    structures = t.supplier.select(i.supplier_id("s_suppkey").alias("accession"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("sasa"))
    bindings = t.supplier.select(i.supplier_id("s_suppkey").alias("accession"), F.col("s_nationkey").alias("num_ligands"))
    return an.bound_structures(accessions, structures, bindings, ["sasa"]).select("id", "sasa", "num_ligands")


@workload("similar_items", """WITH s AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part), x AS (SELECT p_size AS u, p_retailprice AS v FROM part WHERE p_partkey = 7)
SELECT 'P' || p_partkey AS id, round(1 / (1 + sqrt(pow((p_size - u) / (b - a), 2) + pow((p_retailprice - v) / (d - c), 2))), 8) AS similarity FROM part, s, x WHERE p_partkey <> 7 ORDER BY similarity DESC, id LIMIT 10""")
def similar_items(t):
    items = t.part.select(i.part_id("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return an.similar_items(items, "P7", ["a", "b"]).withColumn("similarity", F.round("similarity", 8))


@workload("similar_vectors", """WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT p, max(x) - min(x) AS w FROM p GROUP BY p), q AS (SELECT p, x AS y FROM p WHERE vec_id = 3)
SELECT vec_id, round(1 / (1 + sqrt(sum(pow((x - y) / w, 2)))), 7) AS similarity FROM p JOIN s USING (p) JOIN q USING (p) WHERE vec_id <> 3 GROUP BY vec_id ORDER BY similarity DESC, vec_id LIMIT 10""")
def similar_vectors(t):
    return an.similar_vectors(t.embeddings, 3).withColumn("similarity", F.round("similarity", 7))


@workload("best_ligands", """SELECT accession, ligand, place FROM (SELECT 'S' || l_suppkey AS accession, l_orderkey * 10 + l_linenumber AS ligand,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_tax > 0.02 THEN l_extendedprice END ASC NULLS LAST, l_quantity ASC NULLS LAST, l_orderkey * 10 + l_linenumber) AS place FROM lineitem) WHERE place <= 5""")
def best_ligands(t):
    rows = t.lineitem.select(i.supplier_id().alias("accession"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ligand"),
                             F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")).alias("ki"), F.col("l_quantity").alias("ic50"))
    return an.best_ligands(rows).select("accession", "ligand", "place")


# --- resolution --------------------------------------------------------------

def lookup_rows(t):
    part = lambda key, stage: t.part.select(key.alias("key"), F.lit(stage).alias("stage"), i.part_id("p_partkey").alias("entity"))
    return part(i.part_id("p_partkey"), "canonical").unionByName(part(F.concat(F.lit("id-"), F.col("p_partkey").cast("string")), "project_id")).unionByName(
        part(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit("/"), "p_type"), "symbol")).unionByName(part(F.col("p_name"), "alias"))


SQL_LOOKUP = """lk AS (SELECT lower('P' || p_partkey) AS key, 1 AS rank, 'canonical' AS stage, 'P' || p_partkey AS entity FROM part UNION ALL SELECT 'id-' || p_partkey, 2, 'project_id', 'P' || p_partkey FROM part
 UNION ALL SELECT lower(p_brand || '/' || p_size || '/' || p_type), 3, 'symbol', 'P' || p_partkey FROM part UNION ALL SELECT lower(p_name), 4, 'alias', 'P' || p_partkey FROM part)"""


@workload("resolve_ids", f"""WITH {SQL_LOOKUP}, q AS (SELECT DISTINCT query FROM (SELECT ' p' || p_partkey || ' ' AS query FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT p_brand || '/' || p_size || '/' || p_type FROM part UNION ALL SELECT c_name FROM customer)),
h AS (SELECT query, rank, stage, entity FROM q JOIN lk ON lower(trim(query)) = key), f AS (SELECT query, min(rank) AS rank FROM h GROUP BY 1),
g AS (SELECT h.query, count(DISTINCT entity) AS n, min(entity) AS entity, min(stage) AS stage FROM h JOIN f ON h.query = f.query AND h.rank = f.rank GROUP BY 1)
SELECT q.query, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' WHEN stage = 'alias' THEN 'ALIAS' ELSE 'EXACT' END AS status, CASE WHEN n = 1 THEN entity END AS entity, coalesce(n, 0) AS candidates FROM q LEFT JOIN g USING (query)""")
def resolve_ids(t):
    queries = t.part.select(F.concat(F.lit(" p"), F.col("p_partkey").cast("string"), F.lit(" ")).alias("query")).unionByName(
        t.part.select(F.col("p_name").alias("query"))).unionByName(t.part.select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit("/"), "p_type").alias("query"))).unionByName(
        t.customer.select(F.col("c_name").alias("query")))
    return an.resolve(queries, lookup_rows(t)).select("query", "status", "entity", "candidates")


@workload("resolve_reference", """WITH m AS (SELECT lower(p_name) AS k, count(*) AS n, min('P' || p_partkey) AS e FROM part GROUP BY 1)
SELECT c.o_orderkey AS row, CASE WHEN o_orderkey % 2 = 0 AND p.p_partkey IS NOT NULL THEN 'mapped' WHEN n = 1 THEN 'mapped' WHEN n > 1 THEN 'ambiguous' ELSE 'unmapped' END AS status
FROM orders c LEFT JOIN part p ON p.p_partkey = c.o_custkey AND c.o_orderkey % 2 = 0 LEFT JOIN part s ON s.p_partkey = c.o_custkey + 600 LEFT JOIN m ON m.k = lower(s.p_name)""")
def resolve_reference(t):
    names = t.part.select((F.col("p_partkey") - 600).alias("o_custkey"), F.col("p_name").alias("symbol"))
    rows = t.orders.join(names, "o_custkey", "left").select(
        F.col("o_orderkey").alias("row"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("X"), F.col("o_custkey").cast("string"))).alias("ext_id"), "symbol")
    by_id = t.part.select(F.concat(F.lit("X"), F.col("p_partkey").cast("string")).alias("key"), i.part_id("p_partkey").alias("entity"))
    by_symbol = t.part.select(F.col("p_name").alias("key"), i.part_id("p_partkey").alias("entity"))
    return an.resolve_reference(rows, by_id, by_symbol).select("row", "status")


@workload("memberships", """WITH g AS (SELECT p_type AS "group", upper(p_brand) AS symbol, 1 AS r FROM part UNION SELECT p_type, upper(p_name), 2 FROM part UNION SELECT p_type, upper(p_brand || p_size), 3 FROM part),
q AS (SELECT DISTINCT upper(p_brand) AS symbol FROM part UNION SELECT DISTINCT upper(p_name) FROM part WHERE p_size < 5 UNION SELECT DISTINCT upper(p_brand || p_size) FROM part WHERE p_size > 40)
SELECT q.symbol, "group", CASE min(r) WHEN 1 THEN 'approved' WHEN 2 THEN 'previous' ELSE 'alias' END AS route FROM q JOIN g USING (symbol) GROUP BY 1, 2""")
def memberships(t):
    groups = t.part.select(F.col("p_type").alias("group"), F.col("p_brand").alias("approved"), F.array("p_name").alias("previous"),
                           F.array(F.concat("p_brand", F.col("p_size").cast("string"))).alias("aliases"))
    asked = t.part.select(F.col("p_brand").alias("symbol")).unionByName(t.part.where("p_size < 5").select(F.col("p_name").alias("symbol"))).unionByName(
        t.part.where("p_size > 40").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("symbol")))
    return an.memberships(asked, groups)


@workload("touching_relations", """SELECT DISTINCT 'S' || l_suppkey AS regulator, 'P' || l_partkey AS target FROM lineitem WHERE l_suppkey IN (1, 2) OR l_partkey IN (5, 6, 7)""")
def touching_relations(t):
    relations = t.lineitem.select(i.supplier_id().alias("regulator"), i.part_id().alias("target"))
    return an.touching_relations(t.spark.createDataFrame([("S1",), ("S2",), ("P5",), ("P6",), ("P7",)], "symbol string"), relations)


def annotation_rows(t):
    """Brand, type and size class of every part as annotations."""
    kinds = F.array(F.struct(F.lit("family").alias("kind"), F.col("p_brand").alias("term")), F.struct(F.lit("pathway").alias("kind"), F.col("p_type").alias("term")),
                    F.struct(F.lit("compartment").alias("kind"), (F.col("p_size") % 7).cast("string").alias("term")))
    return t.part.select(i.part_id("p_partkey").alias("entity"), F.lit("catalogue").alias("source"), F.explode(kinds).alias("k")).select("entity", "source", "k.kind", "k.term")


SQL_ANN = """ann AS (SELECT 'P' || p_partkey AS entity, 'family' AS kind, p_brand AS term FROM part UNION ALL SELECT 'P' || p_partkey, 'pathway', p_type FROM part UNION ALL SELECT 'P' || p_partkey, 'compartment', CAST(p_size % 7 AS VARCHAR) FROM part)"""


@workload("merge_annotations", f"""WITH {SQL_ANN}, e AS (SELECT DISTINCT 'P' || (l_partkey * 2) AS entity FROM lineitem) SELECT entity, kind, term FROM ann WHERE entity IN (SELECT entity FROM e) AND kind <> 'pathway'
UNION ALL SELECT entity, 'unresolved', '' FROM e WHERE entity NOT IN (SELECT entity FROM ann)""")
def merge_annotations(t):
    entities = t.lineitem.select(F.concat(F.lit("P"), (F.col("l_partkey") * 2).cast("string")).alias("entity")).distinct()
    identifiers = entities.select("entity", F.col("entity").alias("identifier"))
    found, missing = an.merge_annotations(entities, identifiers, annotation_rows(t).where("kind <> 'pathway'").select("source", F.col("entity").alias("identifier"), "kind", "term"))
    return found.select("entity", "kind", "term").unionByName(missing.select("entity", F.lit("unresolved").alias("kind"), F.lit("").alias("term")))


@workload("sentinels", f"""WITH {SQL_RESP}, m AS (SELECT p_brand || p_size AS symbol, count(*) AS n, max(importance) AS v FROM part JOIN resp ON id = 'P' || p_partkey GROUP BY 1),
x AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'P' || p_partkey ELSE 'Q' || p_partkey END AS id, p_brand || p_size AS symbol FROM part),
j AS (SELECT x.id, x.symbol, CASE WHEN r.id IS NOT NULL THEN 'direct' WHEN n = 1 THEN 'unique_symbol' WHEN n > 1 THEN 'ambiguous' ELSE 'unmapped' END AS mapping, CASE WHEN r.id IS NOT NULL THEN r.importance WHEN n = 1 THEN m.v END AS v FROM x LEFT JOIN resp r ON r.id = x.id LEFT JOIN m ON m.symbol = x.symbol)
SELECT mapping, CASE WHEN v IS NULL THEN 'NOT_EVALUATED' WHEN v >= 760 THEN 'PASS' ELSE 'FAIL' END AS result, count(*) AS n FROM j GROUP BY 1, 2""")
def sentinels(t):
    symbol = F.concat("p_brand", F.col("p_size").cast("string"))
    expected = t.part.select(F.when(F.col("p_partkey") % 2 == 0, i.part_id("p_partkey")).otherwise(F.concat(F.lit("Q"), F.col("p_partkey").cast("string"))).alias("id"), symbol.alias("symbol"), F.lit(760.0).alias("least"))
    mapping = t.part.select(i.part_id("p_partkey").alias("id"), symbol.alias("symbol"))
    return an.sentinel_check(expected, responses(t).select("id", "importance"), mapping).groupBy("mapping", "result").agg(F.count(F.lit(1)).alias("n"))


# --- selection and comparison ------------------------------------------------

@workload("network_losses", f"WITH {SQL_RESP} SELECT id, delta_pct FROM resp WHERE delta_pct < -0.5 ORDER BY delta_pct, id LIMIT 40")
def network_losses(t):
    return se.losses(responses(t), threshold_pct=0.5, limit=40).select("id", "delta_pct")


@workload("top_rows_per_group", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def top_rows_per_group(t):
    return se.top_rows(t.part, [F.desc("p_retailprice"), F.asc("p_partkey")], 3, by=["p_brand"]).select("p_brand", "p_partkey")


@workload("result_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def result_page(t):
    return se.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], number=3, size=25)


@workload("union_keep_first", """SELECT id, any_value(a) AS a, any_value(b) AS b FROM (SELECT p_partkey AS id, p_brand AS a, NULL AS b FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, NULL, p_type FROM part WHERE p_size > 10 AND p_size <= 25) GROUP BY id""")
def union_keep_first(t):
    first = t.part.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("a"))
    second = t.part.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("b"))
    return se.union_keep_first([first, second], "id")


@workload("role_matrix", f"""WITH {SQL_RESP}, t AS (SELECT id FROM resp WHERE importance > 900), l AS (SELECT id, delta_pct FROM resp WHERE delta_pct < -0.3), g AS (SELECT id, delta_pct FROM resp WHERE delta_pct > 0.3)
SELECT r.id, concat_ws(',', CASE WHEN r.id IN (SELECT id FROM t) THEN 'target' END, CASE WHEN delta_pct < -0.3 THEN 'network_loss' END, CASE WHEN delta_pct > 0.3 THEN 'positive_response' END) AS roles,
 CASE WHEN abs(delta_pct) > 0.3 THEN delta_pct END AS delta_pct FROM resp r WHERE r.id IN (SELECT id FROM t) OR abs(delta_pct) > 0.3""")
def role_matrix(t):
    rows = responses(t)
    out = se.role_matrix(rows.where("importance > 900").select("id"), rows.where("delta_pct < -0.3").select("id", "delta_pct"), rows.where("delta_pct > 0.3").select("id", "delta_pct"), ["delta_pct"])
    return out.select("id", F.array_join("roles", ",").alias("roles"), "delta_pct")


@workload("assign_roles", f"""WITH {SQL_RESP}, x AS (SELECT id, importance > 900 AS t, delta_pct > 0 AS g, delta_pct < 0 AS l, importance > 700 AS s FROM resp)
SELECT id, CASE WHEN t THEN 'target' ELSE concat_ws(',', CASE WHEN g THEN 'positive_response' END, CASE WHEN s AND l THEN 'network_loss' END, CASE WHEN s THEN 'fdr_supported' END) END AS roles FROM x WHERE t OR g OR s""")
def assign_roles(t):
    rows = responses(t).select("id", F.when(F.col("delta_pct") > 0, "gain").when(F.col("delta_pct") < 0, "loss").otherwise("no change").alias("direction"), (F.col("importance") > 700).alias("is_significant"), "importance")
    out = se.assign_roles(rows, rows.where("importance > 900").select("id"), mode="null_fdr")
    return out.select("id", F.array_join("roles", ",").alias("roles"))


@workload("quota_pick", f"""WITH {SQL_RESP}, o AS (SELECT 1 AS b, 'gains' AS n, row_number() OVER (ORDER BY delta_pct DESC, id) AS p, id FROM resp UNION ALL SELECT 2, 'losses', row_number() OVER (ORDER BY delta_pct, id), id FROM resp UNION ALL SELECT 3, 'central', row_number() OVER (ORDER BY importance DESC, id), id FROM resp),
k AS (SELECT * FROM o WHERE p <= 10), f AS (SELECT id, min(b * 100 + p) AS w, string_agg(n, '; ' ORDER BY b) AS reasons FROM k GROUP BY id) SELECT id AS entity, reasons FROM f ORDER BY w, id LIMIT 40""")
def quota_pick(t):
    from meshflux.functions.ordering import row_numbers

    rows = cut(responses(t))
    parts = None
    for place, (name, order) in enumerate((("gains", F.desc("delta_pct")), ("losses", F.asc("delta_pct")), ("central", F.desc("importance"))), start=1):
        part = row_numbers(rows, [order, F.asc("id")], name="position").select(F.lit(place).alias("bucket_order"), F.lit(name).alias("bucket"), "position", F.col("id").alias("entity"))
        parts = part if parts is None else parts.unionByName(part)
    return se.quota_pick(parts, budget=40)


@workload("coalesce_requests", """SELECT c_mktsegment AS operation, c_nationkey % 2 AS taxon, lower(n_name) AS text, count(*) AS merged, string_agg(DISTINCT CAST(c_custkey % 5 AS VARCHAR), ',' ORDER BY CAST(c_custkey % 5 AS VARCHAR)) AS entities FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""")
def coalesce_requests(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_mktsegment").alias("operation"), (F.col("c_nationkey") % 2).alias("taxon"), F.concat(F.lit(" "), "n_name").alias("text"),
        F.array((F.col("c_custkey") % 5).cast("string")).alias("entities"), F.array(F.lit("x")).alias("reasons"))
    return se.coalesce_requests(rows).select("operation", "taxon", "text", "merged", F.array_join("entities", ",").alias("entities"))


@workload("pareto_layers", """WITH RECURSIVE x AS MATERIALIZED (SELECT s_suppkey AS id, s_acctbal AS a, (s_suppkey * 37) % 101 AS b, s_nationkey AS c FROM supplier),
d AS MATERIALIZED (SELECT p.id AS lo, q.id AS hi FROM x p JOIN x q ON q.a >= p.a AND q.b >= p.b AND q.c >= p.c AND (q.a > p.a OR q.b > p.b OR q.c > p.c)),
l AS (SELECT id, 1 AS k FROM x UNION SELECT d.lo, l.k + 1 FROM l JOIN d ON d.hi = l.id) SELECT id, max(k) AS layer FROM l GROUP BY id""")
def pareto_layers(t):
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("a"), ((F.col("s_suppkey") * 37) % 101).alias("b"), F.col("s_nationkey").alias("c"))
    return se.pareto_layers(rows, ["a", "b", "c"]).select("id", "layer")


@workload("candidate_search", None)
def candidate_search(t):
    graph = i.hop_graph(t)
    rows = responses(t)
    scores = rows.select("id", F.col("importance").alias("pagerank"), F.abs("delta_pct").alias("betweenness"), "importance", (F.col("importance") > 800).alias("is_bottleneck"),
                         (F.substring("id", 2, 9).cast("int") % 10).alias("community"))
    regulators = t.lineitem.where("l_returnflag = 'R'").select(i.part_id().alias("regulator"), i.supplier_id().alias("target"), F.lit("returned").alias("effect"))
    return se.candidate_search(graph, cut(scores), "S1", regulators, limit=25).select("id", "layer", "nearness", "is_neighbour", "effect")


@workload("validate_candidates", f"""WITH RECURSIVE {i.sql_edges()}, sc AS (SELECT * FROM (VALUES ('S2', ['S2'], 0.05::DOUBLE), ('S3', ['S3'], 0.05::DOUBLE), ('P3', ['P3'], 0.05::DOUBLE)) v(sid, ids, factor)), {i.sql_responses()}, {i.sql_shift("resp")}
SELECT scenario_id AS id, round(delta_pct, 4) AS delta_pct, round(abs(delta_pct), 4) AS effect, round(system_shift_pct, 4) AS system_shift_pct, delta > 0 AS target_responds FROM resp JOIN shift USING (scenario_id) WHERE id = 'S1'""")
def validate_candidates(t):
    from meshflux.operators.propagation import symmetric_arcs

    arcs = cut(symmetric_arcs(i.plain_graph(t)))
    candidates = t.spark.createDataFrame([("S2",), ("S3",), ("P3",)], "id string")
    return se.validate_candidates(arcs, candidates, "S1", factor=0.05).select("id", r("delta_pct", 4), r("effect", 4), r("system_shift_pct", 4), "target_responds")


@workload("betweenness_change", None)
def betweenness_change(t):
    return se.betweenness_change(i.plain_graph(t), ["S2", "S3"], "S1", factor=0.05, sample=8, hops=2)


def engines(t):
    a = responses(t).select("id", "delta_pct")
    b = t.lineitem.groupBy(i.part_id().alias("id")).agg(F.round(F.sum("l_tax") - 1.2, 4).alias("delta_pct"))
    return a, b


SQL_ENGINES = f"""{SQL_RESP}, other AS MATERIALIZED (SELECT 'P' || l_partkey AS id, round(sum(l_tax) - 1.2, 4) AS delta_pct FROM lineitem GROUP BY 1)"""


@workload("compare_outer", f"""WITH {SQL_ENGINES}, a AS (SELECT * FROM resp WHERE importance > 500), b AS (SELECT * FROM other WHERE delta_pct > -0.2)
SELECT coalesce(a.id, b.id) AS id, a.delta_pct AS left_response, b.delta_pct AS right_response, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN a.id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS found_in FROM a FULL JOIN b ON a.id = b.id""")
def compare_outer(t):
    _, b = engines(t)
    out = se.compare_outer(responses(t).where("importance > 500").select("id", "delta_pct"), b.where("delta_pct > -0.2"))
    return se.ordered_by_gap(out).select("id", "left_response", "right_response", "found_in")


@workload("compare_complete", f"""WITH {SQL_ENGINES}, k AS (SELECT r.id, rank() OVER (ORDER BY abs(r.delta_pct) DESC) AS a, rank() OVER (ORDER BY abs(o.delta_pct) DESC) AS b FROM resp r JOIN other o USING (id))
SELECT id, a AS left_rank, b AS right_rank, a - b AS rank_shift FROM k""")
def compare_complete(t):
    return se.compare_complete(*engines(t)).select("id", "left_rank", "right_rank", "rank_shift")


@workload("comparison_summary", f"""WITH {SQL_ENGINES}, k AS (SELECT r.id, r.delta_pct AS x, o.delta_pct AS y, rank() OVER (ORDER BY abs(r.delta_pct) DESC) AS a, rank() OVER (ORDER BY abs(o.delta_pct) DESC) AS b FROM resp r JOIN other o USING (id)),
m AS (SELECT *, row_number() OVER (ORDER BY a, id) AS pa, row_number() OVER (ORDER BY b, id) AS pb, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM k)
SELECT count(*) AS n, round(corr(ra, rb), 7) AS rank_spearman, round(corr(x, y), 7) AS pearson, count(*) FILTER (WHERE pa <= 50 AND pb <= 50) AS overlap_at_50, count(*) FILTER (WHERE pa <= 300 AND pb <= 300) AS overlap_at_300,
 quantile_cont(abs(a - b), 0.5) AS median_shift, round(avg(abs(a - b)), 6) AS mean_shift FROM m""")
def comparison_summary(t):
    out = se.comparison_summary(se.compare_complete(*engines(t)))
    return out.select("n", r("rank_spearman", 7), r("pearson", 7), "overlap_at_50", "overlap_at_300", "median_shift", r("mean_shift", 6))


@workload("synthesize_engines", f"""WITH {SQL_ENGINES}, a AS (SELECT id, delta_pct AS x, rank() OVER (ORDER BY abs(delta_pct) DESC) AS r, count(*) OVER () AS n FROM resp WHERE importance > 500), b AS (SELECT id, delta_pct AS y, rank() OVER (ORDER BY abs(delta_pct) DESC) AS s, count(*) OVER () AS m FROM other),
j AS (SELECT coalesce(a.id, b.id) AS id, x, y, r, s, 1 - (r - 1) / (n - 1)::DOUBLE AS p, 1 - (s - 1) / (m - 1)::DOUBLE AS q, CASE WHEN x > 0.05 THEN 1 WHEN x < -0.05 THEN -1 ELSE 0 END AS u, CASE WHEN y > 0.05 THEN 1 WHEN y < -0.05 THEN -1 ELSE 0 END AS v FROM a FULL JOIN b ON a.id = b.id)
SELECT id, CASE WHEN x IS NULL THEN 'RIGHT_ONLY' WHEN y IS NULL THEN 'LEFT_ONLY' WHEN u = v AND r <= 50 AND s <= 50 THEN 'ROBUST_CROSS_MODEL' WHEN u * v = -1 OR abs(q - p) >= 0.25 THEN 'DIRECTION_SENSITIVE' WHEN r <= 50 AND s > 50 THEN 'LEFT_DOMINANT' WHEN s <= 50 AND r > 50 THEN 'RIGHT_EMERGENT' ELSE 'LOW_AGREEMENT' END AS finding FROM j""")
def synthesize_engines(t):
    return se.synthesize(responses(t).where("importance > 500").select("id", "delta_pct"), engines(t)[1]).select("id", "finding")


@workload("engine_presentation", f"""WITH {SQL_RESP} SELECT 'report' AS part, count(*) AS n FROM (SELECT id FROM resp WHERE delta_pct > 0.05 ORDER BY delta_pct DESC, id LIMIT 30) UNION ALL SELECT 'losses', count(*) FROM resp WHERE delta_pct < -0.05
UNION ALL SELECT 'positive', count(*) FROM resp WHERE delta_pct > 0.05""")
def engine_presentation(t):
    rows = cut(responses(t))
    report, lost, summary = se.presentation(rows, rows.where("id = 'none'"), limit=30)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(report, "report").unionByName(count(lost, "losses")).unionByName(summary.select(F.lit("positive").alias("part"), F.col("positive").alias("n")))


@workload("side_balance", f"""WITH {SQL_RESP}, g AS (SELECT DISTINCT p_brand AS theme FROM resp JOIN part ON id = 'P' || p_partkey WHERE delta_pct > 0.5), l AS (SELECT DISTINCT p_brand AS theme FROM resp JOIN part ON id = 'P' || p_partkey WHERE delta_pct < -0.9)
SELECT coalesce(g.theme, l.theme) AS theme, CASE WHEN g.theme IS NOT NULL AND l.theme IS NOT NULL THEN 'both' WHEN g.theme IS NOT NULL THEN 'gains' ELSE 'losses' END AS side FROM g FULL JOIN l ON g.theme = l.theme""")
def side_balance(t):
    named = responses(t).join(t.part.select(i.part_id("p_partkey").alias("id"), F.col("p_brand").alias("theme")), "id")
    return se.side_balance(named.where("delta_pct > 0.5"), named.where("delta_pct < -0.9"))


@workload("component_sides", f"""WITH {SQL_RESP} SELECT 'P' || p_partkey AS symbol, CASE WHEN delta_pct > 0.4 THEN 'gains' WHEN delta_pct < -0.4 THEN 'losses' ELSE 'outside' END AS side FROM part LEFT JOIN resp ON id = 'P' || p_partkey""")
def component_sides(t):
    rows = responses(t).withColumnRenamed("id", "symbol")
    return se.component_sides(t.part.select(i.part_id("p_partkey").alias("symbol")), rows.where("delta_pct > 0.4"), rows.where("delta_pct < -0.4"))


@workload("independent_support", """WITH RECURSIVE x AS (SELECT p_type AS theme, p_brand AS g, 'P' || p_partkey AS id, p_partkey AS pos FROM part), f AS (SELECT theme, g, min(pos) AS pos FROM x GROUP BY 1, 2),
k AS (SELECT theme, 'P' || pos AS id, row_number() OVER (PARTITION BY theme ORDER BY pos) AS place FROM f) SELECT theme, id, place FROM k WHERE place <= 5""")
def independent_support(t):
    candidates = t.part.select(F.col("p_type").alias("theme"), F.col("p_partkey").alias("position"), i.part_id("p_partkey").alias("id"))
    groups = t.part.select(F.col("p_brand").alias("group"), i.part_id("p_partkey").alias("id"))
    return se.independent_support(candidates, groups).select("theme", "id", "place")


# --- findings ----------------------------------------------------------------

SQL_CPLX = f"""{SQL_RESP}, mem AS (SELECT DISTINCT l_orderkey AS c, 'P' || l_partkey AS id FROM lineitem), tg AS (SELECT DISTINCT c FROM mem WHERE id IN ('P1', 'P2', 'P3')),
j AS (SELECT c, mem.id, CASE WHEN importance > 500 THEN delta_pct END AS d FROM mem LEFT JOIN resp ON resp.id = mem.id WHERE c IN (SELECT c FROM tg)),
cx AS (SELECT c AS complex, count(*) AS members, count(d) AS responding, count(*) FILTER (WHERE d > 0.05) AS positive, count(*) FILTER (WHERE d < -0.05) AS negative, count(*) FILTER (WHERE d IS NULL) AS unresolved,
 round(coalesce(quantile_cont(abs(d), 0.5), 0), 8) AS median_abs, round(CASE WHEN sum(abs(d)) > 0 THEN abs(sum(d)) / sum(abs(d)) ELSE 0 END, 8) AS coherence, round(CASE WHEN sum(abs(d)) > 0 THEN sum(d) / sum(abs(d)) ELSE 0 END, 8) AS balance FROM j GROUP BY c)"""


def complexes(t):
    members = t.lineitem.select(F.col("l_orderkey").alias("complex"), i.part_id().alias("id"))
    targets = t.spark.createDataFrame([("P1",), ("P2",), ("P3",)], "id string")
    return fi.complex_response(members, responses(t).where("importance > 500"), targets)


@workload("complex_response", f"WITH {SQL_CPLX} SELECT * FROM cx")
def complex_response(t):
    return complexes(t).select("complex", "members", "responding", "positive", "negative", "unresolved", r("median_abs", 8), r("coherence", 8), r("balance", 8))


@workload("complex_labels", f"""WITH {SQL_CPLX} SELECT complex, CASE WHEN responding = 0 THEN 'LOW RESPONSE / STABLE' WHEN coherence >= 0.5 AND balance > 0 THEN 'COORDINATED POSITIVE REDISTRIBUTION' WHEN coherence >= 0.5 AND balance < 0 THEN 'COORDINATED NEGATIVE REDISTRIBUTION' ELSE 'MIXED REDISTRIBUTION' END AS left_label FROM cx""")
def complex_labels(t):
    rows = cut(complexes(t).withColumns({"coherence": F.round("coherence", 8), "balance": F.round("balance", 8)}))
    return fi.compare_complexes(rows, rows).select("complex", "left_label")


@workload("group_metrics", f"""WITH {SQL_RESP}, x AS (SELECT p_brand || '/' || p_size AS g, id, delta_pct, importance, p_type AS c FROM resp JOIN part ON id = 'P' || p_partkey),
top AS (SELECT id FROM x ORDER BY delta_pct DESC, id LIMIT 100), nb AS (SELECT DISTINCT 'P' || l_partkey AS id FROM lineitem WHERE l_suppkey = 1),
s AS (SELECT g, count(*) AS members, count(*) FILTER (WHERE id IN (SELECT id FROM top)) / 100.0 AS ts, avg(delta_pct) AS md, quantile_cont(delta_pct, 0.5) AS mm, count(*) FILTER (WHERE id IN (SELECT id FROM nb)) / count(*) AS ns FROM x GROUP BY g HAVING count(*) >= 2),
m AS (SELECT g, max(n) AS modal FROM (SELECT g, c, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY g)
SELECT s.g AS "group", members, ts::DOUBLE AS top_share, round(md, 7) AS mean_delta, round(mm, 7) AS median_delta, round(ns, 7) AS neighbour_share, round(modal / members, 7) AS community_share,
 CASE WHEN members >= 5 OR ts >= 0.15 OR (members >= 3 AND modal / members >= 0.8) THEN 'high' WHEN members >= 3 OR ts >= 0.05 THEN 'medium' ELSE 'low' END AS risk FROM s JOIN m ON s.g = m.g""")
def group_metrics(t):
    key = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"))
    members = t.part.select(key.alias("group"), i.part_id("p_partkey").alias("id"))
    candidates = responses(t).join(t.part.select(i.part_id("p_partkey").alias("id"), F.col("p_type").alias("community")), "id")
    near = t.lineitem.where("l_suppkey = 1").select(i.part_id().alias("id"))
    out = fi.group_metrics(members, candidates, near)
    return out.select("group", "members", "top_share", r("mean_delta", 7), r("median_delta", 7), r("neighbour_share", 7), r("community_share", 7), "risk")


@workload("themes", f"""WITH {SQL_RESP}, x AS (SELECT id, lower(p_name) AS text, greatest(0, delta_pct) AS w FROM resp JOIN part ON id = 'P' || p_partkey),
k AS (SELECT 'warm' AS theme, id, w, word FROM x, (SELECT unnest(['red', 'ring']) AS word) WHERE contains(text, word) UNION ALL SELECT 'cold', id, w, word FROM x, (SELECT unnest(['blue', 'green']) AS word) WHERE contains(text, word)),
g AS (SELECT theme, id, max(w) AS w FROM k GROUP BY 1, 2)
SELECT theme, count(*) AS genes, round(sum(w) + 0.08 * count(*), 4) AS priority FROM g GROUP BY theme""")
def themes(t):
    facts = responses(t).join(t.part.select(i.part_id("p_partkey").alias("id"), F.col("p_name").alias("text")), "id").withColumnRenamed("id", "symbol")
    return fi.themes(facts, rules=(("warm", ("red", "ring")), ("cold", ("blue", "green")))).select("theme", "genes", r("priority", 4))


def side_rows(t):
    return responses(t).select(F.col("id").alias("entity"), F.when(F.col("delta_pct") > 0.3, "gain").when(F.col("delta_pct") < -0.3, "loss").otherwise("no change").alias("direction"))


@workload("shared_annotations", f"""WITH {SQL_RESP}, {SQL_ANN} SELECT kind, term, count(*) AS members FROM ann WHERE entity IN (SELECT id FROM resp WHERE delta_pct > 0.3) GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_annotations(t):
    return fi.shared_annotations(annotation_rows(t), side_rows(t).where("direction = 'gain'"))[0]


@workload("location_distribution", f"""WITH {SQL_RESP}, {i.SQL_LOCATIONS}, x AS (SELECT location FROM locations WHERE id IN (SELECT id FROM resp WHERE delta_pct > 0.3)) SELECT location, count(*) AS entities, round(count(*) / (SELECT count(*) FROM x), 8) AS share FROM x GROUP BY 1""")
def location_distribution(t):
    labels = i.part_locations(t).withColumnRenamed("id", "entity")
    return fi.location_distribution(labels, side_rows(t).where("direction = 'gain'")).withColumn("share", F.round("share", 8))


@workload("side_contrast", f"""WITH {SQL_RESP}, {SQL_ANN}, s AS (SELECT id AS entity, delta_pct > 0.3 AS g FROM resp WHERE abs(delta_pct) > 0.3), n AS (SELECT count(*) FILTER (WHERE g) AS a, count(*) FILTER (WHERE NOT g) AS b FROM s)
SELECT kind, term, count(*) FILTER (WHERE g) AS gains, count(*) FILTER (WHERE NOT g) AS losses, round(count(*) FILTER (WHERE g) / any_value(a), 8) AS gain_share, round(count(*) FILTER (WHERE NOT g) / any_value(b), 8) AS loss_share FROM ann JOIN s USING (entity), n GROUP BY 1, 2""")
def side_contrast(t):
    out = fi.side_contrast(annotation_rows(t), side_rows(t))
    return out.withColumns({"gain_share": F.round("gain_share", 8), "loss_share": F.round("loss_share", 8)})


@workload("gateway_overlap", f"""WITH {SQL_RESP} SELECT CASE WHEN delta_pct > 0 THEN 'positive_response' ELSE 'network_loss' END AS role, count(*) AS entities, count(*) FILTER (WHERE importance > 900) AS significant FROM resp WHERE importance > 700 AND delta_pct <> 0 GROUP BY 1""")
def gateway_overlap(t):
    rows = responses(t).where("delta_pct <> 0").select(F.col("id").alias("entity"), (F.col("importance") > 700).alias("is_bottleneck"), (F.col("importance") > 900).alias("is_significant"),
                                 F.array(F.when(F.col("delta_pct") > 0, "positive_response").otherwise("network_loss")).alias("roles"))
    return fi.gateway_overlap(rows)


@workload("assertions", f"""WITH {SQL_RESP}, {SQL_ANN}, t AS (SELECT unnest(['P1', 'P2', 'P3']) AS entity)
SELECT a.entity AS target, b.entity AS response, 'shared_' || a.kind AS type, a.term AS detail FROM ann a JOIN ann b ON a.kind = b.kind AND a.term = b.term AND a.entity <> b.entity
WHERE a.entity IN (SELECT entity FROM t) AND b.entity IN (SELECT id FROM resp WHERE delta_pct > 0.3)
UNION ALL SELECT DISTINCT 'P' || l_partkey, 'S' || l_suppkey, 'directed_regulation', 'response->target:returned' FROM lineitem WHERE FALSE""")
def assertions(t):
    targets = t.spark.createDataFrame([("P1",), ("P2",), ("P3",)], "entity string")
    relations = t.lineitem.where("l_returnflag = 'R'").select(i.supplier_id().alias("source"), i.part_id().alias("target"), F.lit("returned").alias("effect"))
    out = fi.assertions(targets, side_rows(t).where("direction = 'gain'"), annotation_rows(t), relations)
    return out.select("target", "response", "type", "detail")


@workload("repeated_relationships", f"""WITH {SQL_RESP}, {SQL_ANN} SELECT a.entity AS target, 'shared_' || a.kind AS type, count(DISTINCT b.entity) AS responses FROM ann a JOIN ann b ON a.kind = b.kind AND a.term = b.term AND a.entity <> b.entity
WHERE a.entity IN ('P1', 'P2', 'P3') AND b.entity IN (SELECT id FROM resp WHERE delta_pct > 0.3) GROUP BY 1, 2 HAVING count(DISTINCT b.entity) >= 2""")
def repeated_relationships(t):
    targets = t.spark.createDataFrame([("P1",), ("P2",), ("P3",)], "entity string")
    rows = fi.assertions(targets, side_rows(t).where("direction = 'gain'"), annotation_rows(t))
    return fi.repeated_relationships(rows).select("target", "type", "responses")


@workload("evidence_rows", """SELECT DISTINCT 'S' || l_suppkey AS source, 'P' || l_partkey AS target, l_returnflag AS effect FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size <= 30 AND s_acctbal > 0""")
def evidence_rows(t):
    relations = t.lineitem.select(i.supplier_id().alias("source"), i.part_id().alias("target"), F.col("l_returnflag").alias("effect"))
    symbols = t.part.where("p_size <= 30").select(i.part_id("p_partkey").alias("symbol")).unionByName(t.supplier.where("s_acctbal > 0").select(i.supplier_id("s_suppkey").alias("symbol")))
    return fi.evidence_for(relations, symbols)


@workload("candidate_facts", """SELECT p_partkey AS id, CASE WHEN p_size > 20 THEN p_brand WHEN p_size > 10 THEN p_type END AS family, CASE WHEN p_size > 20 THEN 'report' WHEN p_size > 10 THEN 'cache' ELSE 'missing' END AS family_source FROM part""")
def candidate_facts(t):
    report = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 20, F.col("p_brand")).alias("family"))
    cache = t.part.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("family"))
    return fi.candidate_facts(report, cache, ["family"])


@workload("dose_findings", """WITH d AS (SELECT DISTINCT 1 - l_discount * 9 AS survival, l_discount AS boost FROM lineitem), s AS (SELECT DISTINCT 1 - l_discount * 9 AS survival, l_suppkey FROM lineitem),
f AS (SELECT max(survival) AS f FROM d WHERE boost >= 0.5 * (SELECT max(boost) FROM d)), q AS (SELECT count(*) AS n FROM (SELECT l_suppkey FROM s GROUP BY 1 HAVING count(*) >= 0.5 * (SELECT count(*) FROM d)))
SELECT (SELECT max(boost) FROM d) AS max_boost, CASE WHEN f >= 0.5 THEN 'early' ELSE 'late' END AS compensation, n AS suspects, 'insufficient' AS target_effect,
 CASE WHEN CAST(f >= 0.5 AS INT) + CAST(n >= 2 AS INT) + 1 >= 2 THEN 'high' ELSE 'medium' END AS priority FROM f, q""")
def dose_findings(t):
    survival = (1 - F.col("l_discount") * 9).alias("survival")
    doses = t.lineitem.select(survival, F.col("l_discount").alias("boost")).distinct()
    stressed = t.lineitem.select(survival, i.supplier_id().alias("id"))
    half = t.spark.createDataFrame([(None, "resistant")], "half_loss_survival double, status string")
    return fi.dose_findings(doses, half, stressed).select("max_boost", "compensation", "suspects", "target_effect", "priority")


# --- crosswise ---------------------------------------------------------------

def mapping_rows(t):
    """Symbol pairs between brands-with-size and part ids of the next hundred."""
    kind = F.when(F.col("p_size") % 3 == 0, "ortholog_one2one").when(F.col("p_size") % 3 == 1, "ortholog_one2many").otherwise("ortholog_many2many")
    return t.part.select(F.concat(F.lit("H"), (F.col("p_partkey") % 700).cast("string")).alias("symbol"),
                         F.when(F.col("p_size") % 10 != 0, F.concat(F.lit("M"), (F.col("p_partkey") % 700).cast("string"), F.when(F.col("p_partkey") >= 1400, "b").otherwise(""))).alias("partner"), kind.alias("kind"), F.lit("1").alias("confidence"))


SQL_MAP = """raw AS (SELECT 'H' || (p_partkey % 700) AS symbol, CASE WHEN p_size % 10 <> 0 THEN 'M' || (p_partkey % 700) || CASE WHEN p_partkey >= 1400 THEN 'b' ELSE '' END END AS partner,
 CASE p_size % 3 WHEN 0 THEN 'ONE_TO_ONE' WHEN 1 THEN 'ONE_TO_MANY' ELSE 'MANY_TO_MANY' END AS k FROM part),
n AS (SELECT symbol, count(DISTINCT partner) AS n FROM raw GROUP BY 1),
mp AS MATERIALIZED (SELECT symbol, partner, CASE WHEN n > 1 AND (partner IS NULL OR k <> 'MANY_TO_MANY') THEN 'ONE_TO_MANY' WHEN partner IS NULL THEN 'NO_ORTHOLOG' ELSE k END AS class FROM raw JOIN n USING (symbol)),
bj AS MATERIALIZED (SELECT min(symbol) AS symbol, partner FROM (SELECT DISTINCT symbol, partner FROM mp WHERE class = 'ONE_TO_ONE') GROUP BY partner HAVING count(*) = 1)"""


@workload("classify_mapping", f"WITH {SQL_MAP} SELECT symbol, partner, class, count(*) AS n FROM mp GROUP BY ALL")
def classify_mapping(t):
    return cw.classify_mapping(mapping_rows(t)).groupBy("symbol", "partner", "class").agg(F.count(F.lit(1)).alias("n"))


@workload("mapping_class_counts", f"WITH {SQL_MAP} SELECT class, count(DISTINCT symbol) AS symbols FROM mp GROUP BY 1")
def mapping_class_counts(t):
    return cw.class_counts(cw.classify_mapping(mapping_rows(t)))


def two_species(t):
    first = responses(t).select(F.concat(F.lit("H"), (F.substring("id", 2, 9).cast("int") % 700).cast("string")).alias("symbol"), "delta_pct")
    second = engines(t)[1].select(F.concat(F.lit("M"), (F.substring("id", 2, 9).cast("int") % 700).cast("string")).alias("symbol"), "delta_pct")
    return first, second


SQL_SPECIES = f"""{SQL_ENGINES}, {SQL_MAP}, h0 AS (SELECT 'H' || (CAST(substr(id, 2) AS INT) % 700) AS s, delta_pct AS d FROM resp), m0 AS (SELECT 'M' || (CAST(substr(id, 2) AS INT) % 700) AS s, delta_pct AS d FROM other),
h1 AS (SELECT s, arg_max(d, (abs(d), d)) AS d FROM h0 GROUP BY s), m1 AS (SELECT s, arg_max(d, (abs(d), d)) AS d FROM m0 GROUP BY s),
h AS (SELECT s, d, row_number() OVER (ORDER BY abs(d) DESC, s) AS r, count(*) OVER () AS n FROM h1), m AS (SELECT s, d, row_number() OVER (ORDER BY abs(d) DESC, s) AS r, count(*) OVER () AS n FROM m1),
pr AS (SELECT h.s AS symbol, m.s AS partner, h.d AS x, m.d AS y, h.r / h.n AS p, m.r / m.n AS q, h.r AS a, m.r AS b FROM h JOIN bj ON bj.symbol = h.s JOIN m ON m.s = bj.partner)"""


@workload("compare_mapped", f"""WITH {SQL_SPECIES} SELECT symbol, partner, CASE WHEN x > 0 AND y > 0 THEN 'CONCORDANT_POSITIVE' WHEN x < 0 AND y < 0 THEN 'CONCORDANT_NEGATIVE' WHEN sign(x) <> sign(y) THEN 'DISCORDANT' ELSE 'SPECIES_SPECIFIC_OR_ZERO' END AS consistency FROM pr""")
def compare_mapped(t):
    return cw.compare_mapped(*two_species(t), cw.classify_mapping(mapping_rows(t))).select("symbol", "partner", "consistency")


@workload("mapped_metrics", f"""WITH {SQL_SPECIES}, k AS (SELECT *, rank() OVER (ORDER BY p) AS rp, rank() OVER (ORDER BY q) AS rq FROM pr) SELECT count(*) AS comparable, count(*) FILTER (WHERE x > 0 AND y > 0) AS concordant_positive, round(avg(CASE WHEN x * y > 0 THEN 1 ELSE 0 END), 8) AS concordance,
 count(*) FILTER (WHERE a <= 100 AND b <= 100) AS top_100_overlap, round(corr(rp, rq), 7) AS spearman FROM k""")
def mapped_metrics(t):
    out = cw.comparison_metrics(cw.compare_mapped(*two_species(t), cw.classify_mapping(mapping_rows(t))))
    return out.select("comparable", "concordant_positive", r("concordance", 8), "top_100_overlap", r("spearman", 7))


def partner_symbols(t):
    return t.part.where("p_retailprice < 1300").select(F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("symbol"), i.part_id("p_partkey").alias("id"))


@workload("resolve_partner", f"""WITH {SQL_MAP}, sy AS (SELECT 'M' || p_partkey AS symbol, 'P' || p_partkey AS id FROM part WHERE p_retailprice < 1300),
q AS (SELECT unnest(['H' || p_partkey, 'm' || p_partkey, 'p' || p_partkey, 'ENSP' || p_partkey]) AS query FROM part)
SELECT q.query, CASE WHEN regexp_matches(query, '^ENSP[0-9]+') THEN 'WRONG_SPECIES' WHEN a.id IS NOT NULL THEN 'EXACT_ID' WHEN b.id IS NOT NULL THEN 'EXACT_SYMBOL' WHEN c.id IS NOT NULL THEN 'ORTHOLOG_ALIAS' ELSE 'UNRESOLVED' END AS status, coalesce(a.id, b.id, c.id) AS id
FROM q LEFT JOIN sy a ON lower(a.id) = lower(query) LEFT JOIN sy b ON lower(b.symbol) = lower(query) LEFT JOIN (SELECT bj.symbol, sy.id FROM bj JOIN sy ON sy.symbol = bj.partner) c ON lower(c.symbol) = lower(query)""")
def resolve_partner(t):
    forms = F.array(*[F.concat(F.lit(p), F.col("p_partkey").cast("string")) for p in ("H", "m", "p", "ENSP")])
    queries = t.part.select(F.explode(forms).alias("query"))
    return cw.resolve_partner(queries, partner_symbols(t), cw.classify_mapping(mapping_rows(t)))


@workload("suitability", f"""WITH {SQL_MAP}, sy AS (SELECT 'M' || p_partkey AS symbol, 'P' || p_partkey AS id, p_size FROM part WHERE p_retailprice < 1300), q AS (SELECT 'H' || p_partkey AS query FROM part),
g AS (SELECT symbol, count(DISTINCT partner) AS n, min(partner) AS partner, bool_or(class IN ('ONE_TO_MANY', 'MANY_TO_MANY') AND partner IS NOT NULL) AS several FROM mp GROUP BY 1)
SELECT query, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n = 0 THEN 'NO_DIRECT_ORTHOLOG' WHEN n > 1 OR several THEN 'MULTIPLE_ORTHOLOGS' WHEN id IS NULL OR p_size <= 5 THEN 'ORTHOLOG_EXISTS_NOT_IN_GRAPH' WHEN p_size <= 25 THEN 'ORTHOLOG_EXISTS_CONTEXT_UNAVAILABLE' ELSE 'DIRECT_ORTHOLOG_AVAILABLE' END AS status
FROM q LEFT JOIN g ON g.symbol = query LEFT JOIN sy ON sy.symbol = g.partner""")
def suitability(t):
    queries = t.part.select(F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("query"))
    nodes = t.part.where("p_size > 5").select(i.part_id("p_partkey").alias("id"))
    members = t.part.where("p_size > 25").select(i.part_id("p_partkey").alias("id"))
    return cw.suitability(queries, cw.classify_mapping(mapping_rows(t)), partner_symbols(t), nodes, members).select("query", "status")


@workload("proxies", f"""WITH {SQL_ANN}, t AS (SELECT kind, term FROM ann WHERE entity = 'P7'), x AS (SELECT a.entity AS id, count(*) FILTER (WHERE a.kind = 'family') AS f, count(*) FILTER (WHERE a.kind = 'pathway') AS p, count(*) FILTER (WHERE a.kind = 'compartment') AS c FROM ann a JOIN t USING (kind, term) WHERE a.entity <> 'P7' GROUP BY 1)
SELECT id, f AS same_family, p AS pathways, c AS compartments FROM x ORDER BY f DESC, p DESC, c DESC, id DESC LIMIT 10""")
def proxies(t):
    rows = annotation_rows(t)
    others = rows.where("entity <> 'P7'").select(F.col("entity").alias("id"), "kind", "term", F.lit(False).alias("supported"))
    return cw.proxies(rows.where("entity = 'P7'"), others).select("id", "same_family", "pathways", "compartments")


# --- text --------------------------------------------------------------------

@workload("symbol_mentions", """WITH d AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS symbol FROM benchmark), w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z0-9]+'))) AS symbol FROM documents)
SELECT doc_id, symbol FROM w WHERE symbol IN (SELECT symbol FROM d WHERE len(symbol) >= 3)""")
def symbol_mentions(t):
    symbols = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("symbol"))
    return tx.symbol_mentions(t.documents, symbols)


QUERY = "the onsenti of erblest thon and whou"
SQL_TOKENS = f"list_distinct(regexp_extract_all(lower(text), '{tx.TOKEN}'))"


@workload("search_tfidf", f"""WITH w AS (SELECT doc_id, unnest(list_filter({SQL_TOKENS}, lambda x: x IN ('onsenti', 'erblest', 'thon', 'whou'))) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
i AS (SELECT term, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM w, n GROUP BY term, n)
SELECT doc_id, round(sum(idf), 7) AS score, count(*) AS matched FROM w JOIN i USING (term) GROUP BY doc_id ORDER BY sum(idf) DESC, doc_id LIMIT 20""")
def search_tfidf(t):
    return tx.search_tfidf(t.documents, QUERY).withColumn("score", F.round("score", 7))


@workload("search_bm25", f"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '{tx.TOKEN}') AS ws FROM documents), l AS (SELECT avg(len(ws)) AS mean, count(*) AS n FROM w),
h AS (SELECT doc_id, len(ws) AS len_, term, len(list_filter(ws, lambda x: x = term)) AS tf FROM w, (SELECT unnest(['onsenti', 'erblest', 'thon', 'whou']) AS term)), k AS (SELECT * FROM h WHERE tf > 0),
f AS (SELECT term, count(*) AS df FROM k GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len_ / mean))), 6) AS score, count(*) AS matched FROM k JOIN f USING (term), l GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def search_bm25(t):
    return tx.search_bm25(t.documents, QUERY).withColumn("score", F.round("score", 6))


@workload("passages", None)
def passages(t):
    """Best sentences of every document for a query and two entity terms."""
    return tx.passages(t.documents, QUERY, ["thon", "whou"]).select("doc_id", "rank", "section", "place", "entity_hits", "query_hits", "sentence")
