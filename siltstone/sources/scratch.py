"""Tables written to the shared folder of a cluster, and row numbers within groups of any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows and bytes of a side that is broadcast at most; a larger side is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where that is unset, a local session gets a temporary folder, and a
    cluster, whose machines share none, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
    return base.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The table written to the shared folder, and reread. It outlives the executors that wrote it and goes when the
    driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """The table, marked for broadcast if it has at most BROADCAST_ROWS rows and, where ``size`` gives the bytes of a row,
    BROADCAST_BYTES in all. The table is counted: look at it only once it is written or cheap."""
    n, held = df.agg(F.count("*"), F.sum(F.lit(0) if size is None else size)).first()
    return df if n > BROADCAST_ROWS or (held or 0) > BROADCAST_BYTES else F.broadcast(df)


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "nth") -> DataFrame:
    """Rows numbered from 1 within their group, by columns that are never null. The rows are dealt to ranges of group and
    order and written; each range is numbered on its own and starts after the ranges before it, so that no task holds a
    large group."""
    dealt = df.repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id())
    slices = written(dealt, "numbered")
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = slices.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    starts = counts.select(*by, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order))
    both = slices.withColumn("_own", own).join(starts, [*by, "_slice"])
    return both.withColumn(name, F.col("_start") + F.col("_own")).drop("_slice", "_own", "_start")
