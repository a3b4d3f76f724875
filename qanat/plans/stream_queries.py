"""Queries of ledgers and event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qanat.functions.session import checkpoint_dir, cut
from qanat.operators.audit import latest
from qanat.plans.registry import query
from qanat.streaming import ledger


@query("""SELECT work_id, event_id, event_type, attempt FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY event_at DESC, event_id DESC, received_at DESC) AS k FROM writer_log WHERE work_id IS NOT NULL) WHERE k = 1""")
def latest_event_per_key(t):
    return latest(t.writer_log.where("work_id IS NOT NULL"), ["work_id"], ["event_at", "event_id", "received_at"], ["event_id", "event_type", "attempt"])


@query("""WITH once AS (SELECT DISTINCT ON (event_id) * FROM writer_log ORDER BY event_id, received_at)
  SELECT coalesce(writer_model, 'None') AS writer_model, count(*) AS events, count(*) FILTER (event_type = 'candidate') AS candidates, count(*) FILTER (event_type = 'rejected') AS rejected, max(attempt) AS most_attempts, count(DISTINCT rejection) AS reasons FROM once GROUP BY 1""")
def writer_funnel(t):
    own = latest(t.writer_log.where("event_id IS NOT NULL").withColumn("early", -F.unix_micros("received_at")), ["event_id"], ["early"], ["writer_model", "event_type", "attempt", "rejection"])
    return own.groupBy(F.coalesce("writer_model", F.lit("None")).alias("writer_model")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "candidate").alias("candidates"), F.count_if(F.col("event_type") == "rejected").alias("rejected"), F.max("attempt").alias("most_attempts"), F.countDistinct("rejection").alias("reasons"))


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS events, sum(value) AS total FROM events GROUP BY 1, 2")
def event_tumbling(t):
    return ledger.tumbling(t.events, "ts", "1 hour", ["event_type"])


@query("""SELECT CAST(time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS TIMESTAMP) AS window_start, count(*) AS events FROM events, (VALUES (0), (1)) v(i) GROUP BY 1""")
def event_sliding(t):
    return ledger.sliding(t.events, "ts", "1 hour", "30 minutes")


@query("""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
  SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS session_start, CAST(max(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS session_end, count(*) AS events FROM numbered GROUP BY user_id, s""")
def event_sessions(t):
    return ledger.sessions(t.events, "user_id", "ts", "30 minutes")


@query("SELECT event_id, work_id, event_type FROM writer_log GROUP BY ALL")
def stream_dedup(t):
    """The ledger read as a stream, each event once, into a table of the checkpoint folder, which goes when the session ends its application."""
    spark = t._spark
    out = f"{checkpoint_dir(spark).rstrip('/')}/stream_dedup_{spark.sparkContext.applicationId}_{uuid.uuid4().hex}"
    stream = ledger.files(spark, f"{t._folder}/writer_log.parquet", t.writer_log.schema)
    done = ledger.once(stream, "event_id", "event_at", "400 days").select("event_id", "work_id", "event_type")
    ledger.drain(done, f"{out}/table", f"{out}/state")
    return cut(spark.read.schema(done.schema).parquet(f"{out}/table"), remove=out)


@query("SELECT work_id, CAST(count(*) AS BIGINT) AS events, max(attempt) AS attempts FROM (SELECT DISTINCT event_id, work_id, attempt FROM writer_log WHERE work_id IS NOT NULL) GROUP BY 1")
def stream_counts(t):
    """Events by work, counted in micro-batches that come in any order and laid out in order at the end."""
    spark = t._spark
    out = f"{checkpoint_dir(spark).rstrip('/')}/stream_counts_{spark.sparkContext.applicationId}_{uuid.uuid4().hex}"
    stream = ledger.files(spark, f"{t._folder}/writer_log.parquet", t.writer_log.schema).where("work_id IS NOT NULL")
    ledger.drain(ledger.once(stream, "event_id", "event_at", "400 days").select("event_id", "work_id", "attempt"), f"{out}/table", f"{out}/state")
    own = spark.read.schema("event_id bigint, work_id string, attempt int").parquet(f"{out}/table")
    return cut(own.groupBy("work_id").agg(F.count("*").alias("events"), F.max("attempt").alias("attempts")).orderBy("work_id"), remove=out)
