"""Session set-up and lineage cuts for iterative jobs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "meshflux", cpus: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the library is tuned for.

    On a cluster the session comes from ``spark-submit``; nothing in the library
    calls this function.
    """
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut tables: ``spark.checkpoint.dir``, or else a folder of the warehouse.

    Both belong to the whole cluster; a machine-local folder would be lost with
    its executor. Without either no loop starts, nor with a warehouse on the
    local disk of a cluster, which is where it is by default.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise ValueError("spark.checkpoint.dir or spark.sql.warehouse.dir must name a shared folder")
    if (warehouse.startswith("file:") or "://" not in warehouse and not warehouse.startswith("hdfs:")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder: the warehouse is on a local disk")
    return f"{warehouse.rstrip('/')}/_intermediate"


class Lineage:
    """Writes intermediate tables to the shared folder and reads them back.

    A table that has been replaced by a newer round can be dropped, so a long
    loop holds two rounds on disk, not all of them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/meshflux-{spark.sparkContext.applicationId}"
        self._tables: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._cut_path = path
        self._tables.append(table)
        return table

    def held(self, table: DataFrame, *columns: str) -> DataFrame:
        """Some columns of a table: of the file of one that is cut already, else written."""
        rows = table.select(*columns)
        path = getattr(table, "_cut_path", None)
        if path is None:
            return self.cut(rows)
        rows._cut_path = path
        return rows

    def release(self, *keep: DataFrame) -> None:
        """Delete the tables this lineage has cut, but for those to keep."""
        kept = {getattr(table, "_cut_path", None) for table in keep}
        for table in self._tables:
            if table._cut_path not in kept:
                self.drop(table)
        self._tables = [table for table in self._tables if table._cut_path in kept]

    def read(self, table: DataFrame) -> DataFrame:
        """The same cut table, seen by this lineage's session."""
        again = self.spark.read.schema(table.schema).parquet(table._cut_path)
        again._cut_path = table._cut_path
        return again

    def drop(self, table: DataFrame | None) -> None:
        path = getattr(table, "_cut_path", None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all cut tables of this application; results that read them are gone too."""
    root = Lineage(spark).root
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def loop_lineage(spark: SparkSession) -> Lineage:
    """A sibling session for loops over co-partitioned, cached tables.

    The layout of such a loop is fixed by hand (partitioned, sorted, salted), so
    adaptive re-planning after every stage only adds latency. The caller's own
    session settings stay untouched.
    """
    sibling = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            sibling.conf.set(key, value)
    sibling.conf.set("spark.sql.adaptive.enabled", "false")
    lineage = Lineage(sibling)
    lineage.root = Lineage(spark).root
    return lineage


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and return the written table."""
    return Lineage(df.sparkSession).cut(df)
