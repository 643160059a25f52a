"""The folder that driver and executors share, and frames stored there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = getattr(spark, "_catweave_shared", None)
        if where is None:
            where = spark._catweave_shared = "file://" + tempfile.mkdtemp(prefix="catweave-")
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder there, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` stored as Parquet: its lineage ends there, and a lost executor costs nothing done before."""
    path = f"{scratch(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with dense numbers from 0 in the given order, without sorting in one task.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the rows of
    the partitions before, of which there is one count each.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = placed.withColumn("_part", part).join(F.broadcast(base), "_part")  # a row a partition
    return out.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_base", "_at")
