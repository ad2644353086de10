"""Table schemas and the required-column guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INTERACTIONS = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("score", T.IntegerType()),
])

CONTEXT_LEVELS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("level", T.DoubleType()),
])

EDGES = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("is_bridge", T.BooleanType()),
])

OVERLAY = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("stimulation", T.BooleanType()),
    T.StructField("inhibition", T.BooleanType()),
    T.StructField("consensus_direction", T.BooleanType()),
    T.StructField("consensus_stimulation", T.BooleanType()),
    T.StructField("consensus_inhibition", T.BooleanType()),
    T.StructField("provenance", T.StringType()),
    T.StructField("references", T.StringType()),
    T.StructField("organism", T.StringType()),
    T.StructField("snapshot_version", T.StringType()),
    T.StructField("evidence_status", T.StringType()),
    T.StructField("evidence_layer", T.StringType()),
])


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, *names: str, what: str = "input") -> DataFrame:
    """Raise before any job runs when a declared column is absent."""
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise MissingColumns(f"{what} lacks required columns: {absent}")
    return df
