"""Queries of job events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.tables import table
from quire.streaming import jobs as J

_S = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END"


def events(spark, sf):
    return table(spark, sf, "events")


@query("""WITH j AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, epoch_us(ts) AS a, CAST(trunc(value * 1e6) AS BIGINT) AS s FROM events WHERE event_type = 'signup'), t AS (SELECT *, sum(s) OVER w AS total FROM j WINDOW w AS (PARTITION BY user_id, day ORDER BY a, event_id)),
m AS (SELECT *, max(a - (total - s)) OVER (PARTITION BY user_id, day ORDER BY a, event_id) AS m FROM t) SELECT event_id, CAST(total - s + m - a AS BIGINT) AS wait_us FROM m""")
def fifo_queue_wait(spark, sf):
    return J.fifo_waits(events(spark, sf))


_M = f"SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS start, count(*) FILTER ({_S} = 'done') AS done, count(*) FILTER ({_S} = 'failed') AS failed, count(*) AS events FROM events GROUP BY 1"


@query(_M)
def job_metrics_15m(spark, sf):
    return J.metrics(events(spark, sf))


@query(f"WITH m AS ({_M}), b AS (SELECT *, epoch_us(start) // 900000000 - row_number() OVER (ORDER BY start) AS g FROM m WHERE done + failed >= 2 AND failed > 0.4 * (done + failed)) SELECT min(start) AS start, count(*) AS windows FROM b GROUP BY g HAVING count(*) >= 2")
def alert_hold(spark, sf):
    return J.alerts(J.metrics(events(spark, sf)), 0.4, 2, 2)


@query(f"SELECT event_type, count(*) AS n, min(ts) AS first FROM events WHERE {_S} NOT IN ('done', 'failed') OR ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def retention_filter(spark, sf):
    return J.retained(events(spark, sf), "2024-01-20").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))


@query(f"WITH e AS (SELECT {_S} AS to_state, lag({_S}) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS f FROM events) SELECT coalesce(f, 'none') AS from_state, to_state, count(*) AS n FROM e GROUP BY ALL")
def job_transitions(spark, sf):
    return J.transitions(events(spark, sf))


@query(f"WITH e AS (SELECT event_id, ts, {_S} AS s, min(CASE WHEN {_S} IN ('done', 'failed') THEN ts END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e FROM events) SELECT event_id, e IS NULL OR epoch_us(e) - epoch_us(ts) > 1800 * 1000000 AS late FROM e WHERE s = 'running'")
def job_deadline(spark, sf):
    return J.overdue(events(spark, sf), 1800)


@query(f"WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, {_S} AS s FROM events), t AS (SELECT user_id, day, arg_min(s, struct_pack(t := ts, e := event_id)) AS s FROM e WHERE s IN ('done', 'failed') GROUP BY ALL), l AS (SELECT user_id, day, arg_max(s, struct_pack(t := ts, e := event_id)) AS s FROM e GROUP BY ALL) SELECT l.user_id, l.day, coalesce(t.s, l.s) AS state FROM l LEFT JOIN t USING (user_id, day)".replace("l.day,", "CAST(l.day AS VARCHAR) AS day,"))
def final_states(spark, sf):
    return J.final_states(events(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("""WITH i AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(trunc(value * 60e6) AS BIGINT) AS b FROM events), o AS (SELECT *, max(b) OVER (PARTITION BY user_id, day ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR a > seen THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, CAST(day AS VARCHAR) AS day, min(a) AS start_us, max(b) AS end_us, count(*) AS n FROM g GROUP BY user_id, day, g""")
def interval_islands(spark, sf):
    return J.busy_intervals(events(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query(_M.replace("SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS start", "SELECT epoch_us(time_bucket(INTERVAL 15 MINUTES, ts)) AS start_us"))
def stream_job_metrics(spark, sf):
    """The metrics as a stream: the same as in batch."""
    return J.stream_metrics(spark, sf).select(F.unix_micros("start").alias("start_us"), "done", "failed", "events")


@query("SELECT event_id, event_type FROM events")
def stream_dedupe(spark, sf):
    return J.stream_once(spark, sf)


@query()
def stream_job_states(spark, sf):
    return J.stream_states(spark, sf)


@query(f"WITH m AS ({_M}) SELECT 'jobs_total{{state=\"done\"}} ' || done || ' ' || epoch_us(start) // 1000000 || '000' AS line FROM m UNION ALL SELECT 'jobs_total{{state=\"failed\"}} ' || failed || ' ' || epoch_us(start) // 1000000 || '000' FROM m")
def prometheus_lines(spark, sf):
    return J.prometheus(J.metrics(events(spark, sf)).withColumn("start", F.col("start").cast("timestamp")))
