"""Append-only ledgers as streams: resumable appends, last write per key, windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resume(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform=lambda df: df) -> None:
    """Appends what is new in the folder ``source`` to the Parquet folder ``target`` and returns when all is read.

    The checkpoint remembers what was done; a second call appends nothing twice.
    """
    stream = transform(spark.readStream.schema(schema).parquet(source))
    drain(stream, target, checkpoint)


def files(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet file or folder as a stream. Streams read folders, so a file is named by a pattern that only it meets."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).parquet(path)


def drain(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Appends all that the stream has to the Parquet folder ``target`` and returns."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def once(stream: DataFrame, key: str, time: str, delay: str = "30 days") -> DataFrame:
    """Each event id once, if its repeats come within ``delay``; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, time: str, size: str, keys: list[str]) -> DataFrame:
    """(window_start, keys, events, total): the same on a table and, with a watermark, on a stream."""
    w = F.window(time, size)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "events", "total")


def sliding(events: DataFrame, time: str, size: str, slide: str) -> DataFrame:
    w = F.window(time, size, slide)
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "events")


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, session_start, session_end, events): runs of a key's events without a pause of ``gap``; the end is the last event plus the gap."""
    w = F.session_window(time, gap)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def guard(spark: SparkSession, manifest: str, checkpoint: str, signature: dict[str, str]) -> None:
    """Refuses to resume a run that was begun under another signature, or one that left a checkpoint and no manifest; else writes the manifest.

    The manifest is one JSON file with the sorted signature and its hash; both places may be on any file system of the cluster.
    """
    import hashlib
    import json

    text = json.dumps(signature, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    digest = hashlib.sha256(text.encode()).hexdigest()
    path = lambda x: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
    fs = path(manifest).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(manifest)):
        have = spark.read.text(manifest, wholetext=True).collect()[0][0]  # one small file
        if json.loads(have).get("run_signature_sha256") != digest:
            raise ValueError("this run was begun with another configuration")
        return
    if fs.exists(path(checkpoint)) and fs.getContentSummary(path(checkpoint)).getLength() > 0:
        raise ValueError("a checkpoint without a manifest")
    out = fs.create(path(manifest), False)
    out.write(bytearray(json.dumps({"run_signature_sha256": digest, "signature": signature}, sort_keys=True).encode()))
    out.close()


def collisions(last: DataFrame, config: DataFrame, fields: list[str], key: str = "work_id") -> DataFrame:
    """(key, field): works whose last event was made under another configuration than the one row of ``config``; nulls differ from all but nulls."""
    now = F.broadcast(config.select(*[F.col(f).alias(f"_{f}") for f in fields]))  # one row
    differs = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    return last.crossJoin(now).select(key, F.explode(differs).alias("field"))
