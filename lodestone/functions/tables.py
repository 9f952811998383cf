"""Intermediate tables in the folder that all executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (only where that is unset, and driver and executors are one) a local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the folder then goes with the cluster's own clean-up
        pass


#: Rows and bytes of an Arrow batch at most: whole texts make batches large.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds _i, each row's place from 0 in the order, which must be one: rows are dealt by ranges, numbered within them, and
    the ranges' sizes, a row each, add up before."""
    spark = df.sparkSession
    ranges = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_p", F.spark_partition_id())
    placed = Scratch(spark).write(ranges, "ranges")
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    nth = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return placed.withColumn("_nth", nth).join(starts, "_p").withColumn("_i", F.col("_from") + F.col("_nth")).drop("_p", "_nth", "_from")


class Scratch:
    """Intermediate tables in the shared folder. A written table cuts the lineage and outlives executors.

    Starting one also keeps the session's Arrow batches to ARROW_ROWS rows and (where Spark has that bound) ARROW_BYTES.
    """

    def __init__(self, spark: SparkSession):
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        if spark.conf.isModifiable("spark.sql.execution.arrow.maxBytesPerBatch"):  # get(name, None) would miss what has its default
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")
        self.spark, self.top, self.paths = spark, shared_dir(spark).rstrip("/"), {}

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.top}/lodestone-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        atexit.register(_delete, self.spark, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    @contextmanager
    def folder(self, name: str) -> Iterator[str]:
        """A folder of its own in the shared one, deleted at the end."""
        path = f"{self.top}/lodestone-{name}-{uuid.uuid4().hex}"
        try:
            yield path
        finally:
            _delete(self.spark, path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        if held := self.paths.pop(id(df), None):
            _delete(self.spark, held[0])
