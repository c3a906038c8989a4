"""Streaming queries run to the end of the data, so that their result can be compared with SQL over the same table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docketspark.plans.registry import query
from docketspark.session import shared_dir, table
from docketspark.streaming import ingest as I
from docketspark.streaming.stages import staged


def _to_the_end(spark, stream, mode: str):
    """The stream's output so far, as a table in the shared folder."""
    base = f"{shared_dir(spark)}/docketspark/stream-{uuid.uuid4().hex}"

    def keep(rows, number):
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(out).option("basePath", f"{base}/out").parquet(f"{base}/out")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streaming_windows(spark, d):
    """Stage events counted by hour, as a stream in complete mode; the last batch holds the whole answer."""
    like = table(spark, d, "events")
    stream = I.table_stream(spark, f"{d}/events.parquet", like).withColumn("ts", F.col("ts").cast("timestamp"))
    found = _to_the_end(spark, I.windowed_counts(stream), "complete")
    last = found.agg(F.max("batch")).scalar()
    return found.filter(F.col("batch") == last).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
       SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    """Sessions of users; the same function serves a stream."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return I.user_sessions(events, "6 hours")


_STAGE = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END"


@query(f"""WITH e AS (SELECT user_id, ts, {_STAGE} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
       o AS (SELECT user_id, max(k) AS k FROM e WHERE s > 0 GROUP BY 1),
       g AS (SELECT e.user_id, max(s) AS stage, count(*) FILTER (WHERE s = 0 AND e.k > coalesce(o.k, 0)) AS failures, count(*) AS n, max(ts) AS seen FROM e LEFT JOIN o ON o.user_id = e.user_id GROUP BY 1)
       SELECT user_id AS document_id, stage, failures, n, CASE WHEN failures >= 3 THEN 'failed' WHEN failures = 0 AND stage = 4 THEN 'ready' WHEN seen + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR THEN 'stalled' WHEN failures > 0 THEN 'retrying' ELSE 'processing' END AS status FROM g""", stage="INTEGER", failures="INTEGER")
def staged_documents(spark, d):
    """Users as documents whose events are stages and failures: a stream's last word on each, timers included."""
    path = f"{d}/events.parquet"
    stream = I.table_stream(spark, path, table(spark, d, "events"))
    events = stream.select(F.col("user_id").alias("document_id"), F.expr(_STAGE).alias("stage"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    found = _to_the_end(spark, staged(events, 4), "append")
    last = found.groupBy("document_id").agg(F.max_by(F.struct("stage", "failures", "n", "status"), F.struct("batch", "n")).alias("x"))
    return last.select("document_id", "x.*")
