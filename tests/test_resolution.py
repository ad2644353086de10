"""Resolution of reference ids and symbols where many entities share a key."""

import threading

from pyspark.sql import functions as F

from meshflux.operators.annotate import resolve_reference


def test_every_way_a_row_resolves(spark):
    rows = [("a", "x1", "s"), ("b", "x2", "many"), ("c", None, "many"), ("d", None, " One "), ("e", "none", None),
            ("f", "x1", None), ("f", "x3", None), ("g", None, "one"), ("g", None, "same"), ("h", "blank", "one"), (None, "x1", "one")]
    by_id = [("X1", "E1"), ("x3", "E3"), ("x1", "E1"), ("blank", None), (None, "E8")]
    by_symbol = [("many", "E4"), ("many", "E5"), ("MANY", None), ("one", "E6"), ("same", "E6")]
    found = resolve_reference(
        spark.createDataFrame(rows, "row string, ext_id string, symbol string"), spark.createDataFrame(by_id, "key string, entity string"),
        spark.createDataFrame(by_symbol, "key string, entity string"))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = [("a", "mapped", "E1"), ("b", "ambiguous", None), ("c", "ambiguous", None), ("d", "mapped", "E6"), ("e", "unmapped", None),
            ("f", "ambiguous", None), ("f", "ambiguous", None), ("g", "mapped", "E6"), ("g", "mapped", "E6"), ("h", "unmapped", None), (None, "unmapped", None)]
    assert got == sorted(want, key=repr)


def test_a_key_of_very_many_entities(spark):
    """Rows and entities of one key do not meet pairwise: 900 million pairs would not end in the time given."""
    n = 30_000
    rows = spark.range(n).select(F.col("id").alias("row"), F.lit(None).cast("string").alias("ext_id"), F.lit("name").alias("symbol"))
    table = spark.range(n).select(F.lit("Name").alias("key"), F.col("id").cast("string").alias("entity"))
    tag = "very-many-entities"
    spark.addTag(tag)
    late = threading.Timer(60, lambda: spark.interruptTag(tag))
    late.start()
    try:
        found = resolve_reference(rows, table.where("false"), table).groupBy("status").count().collect()
    finally:
        late.cancel()
        spark.removeTag(tag)
    assert [tuple(r) for r in found] == [("ambiguous", n)]
