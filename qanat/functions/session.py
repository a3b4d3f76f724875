"""Where intermediate tables are kept, and how small inputs are spread over the cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast; they are counted.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a folder of this machine only for a local master."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if not have.isEmpty():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="qanat-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, remove: str | None = None) -> DataFrame:
    """``df`` written to the checkpoint folder, with its lineage cut; it outlives any executor. ``remove``: a folder that isn't needed afterwards."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    if remove:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(remove)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder and read again: a fraction of a checkpoint's bytes where values repeat. The files go when the session's file system closes, and what was shuffled for them at once."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark), f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    # What was shuffled for it goes from disk when the driver finds it unreachable, which else may be much later. The listener bus holds the last query until another ends.
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer parts than there are; large inputs already do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored_bytes(df: DataFrame) -> int:
    """Bytes that ``df`` reads, as its files tell; of a plan that doesn't know them, the bytes of its rows as JSON."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 56:
        return size
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))).collect()[0][0] or 0


def small(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """``df`` to be broadcast if it reads no more than ``most`` bytes; a larger one is left to the planner."""
    return F.broadcast(df) if stored_bytes(df) <= most else df


def measured(df: DataFrame) -> DataFrame:
    """``df`` kept, and to be broadcast if it has BROADCAST_ROWS at most, as counted: the planner's guess falls far short of what an explode makes."""
    df = cut(df)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def lookup(df: DataFrame, slots: int, kind: str) -> DataFrame:
    """One row with the column ``table``, an array of ``slots`` values: those of ``df`` (slot, value), one a slot, and 0 elsewhere."""
    filled = df.sparkSession.range(slots).select(F.col("id").alias("slot")).join(df.hint("merge"), "slot", "left").select("slot", F.coalesce("value", F.lit(0)).cast(kind).alias("value"))
    return filled.agg(F.sort_array(F.collect_list(F.struct("slot", "value")))["value"].alias("table"))


def with_lookup(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df`` with ``table`` as the column ``table``. Used once, within one expression, it is a constant of that expression and in no row."""
    return df.withColumn("table", table.scalar())
