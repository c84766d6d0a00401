"""Job events: queues, states, deadlines, retention, metrics and alerts, as batch operators and as streams.

An event has event_id, ts, user_id, event_type and value. ``STATES`` says which state a type of event means. Streams
read the same table by files, with a watermark, and write to the checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import checkpoint_dir

STATES = {"signup": "queued", "view": "running", "click": "running", "purchase": "done", "error": "failed"}
TERMINAL = ("done", "failed")


def state(event_type: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return m[event_type]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def fifo_waits(events: DataFrame) -> DataFrame:
    """``event_id, wait_us``: how long each job waits in its tenant's queue of one worker, by day.

    With S the running sum of service times, a job ends at S + max over earlier jobs of (arrival - S before it).
    """
    j = events.where(F.col("event_type") == "signup").select("event_id", "user_id", F.to_date("ts").alias("day"), micros(F.col("ts")).alias("a"), (F.col("value") * 1e6).cast("bigint").alias("s"))
    w = Window.partitionBy("user_id", "day").orderBy("a", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("total", F.sum("s").over(w)).withColumn("m", F.max(F.col("a") - (F.col("total") - F.col("s"))).over(w))
    return j.select("event_id", (F.col("total") - F.col("s") + F.col("m") - F.col("a")).alias("wait_us"))


def metrics(events: DataFrame, width: str = "15 minutes") -> DataFrame:
    """``start, done, failed, users`` of each window of time."""
    s = state(F.col("event_type"))
    return events.groupBy(F.window("ts", width).alias("w")).agg(F.count_if(s == "done").alias("done"), F.count_if(s == "failed").alias("failed"), F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "done", "failed", "events")


def alerts(windows: DataFrame, share: float, least: int, hold: int) -> DataFrame:
    """``start, windows``: where the share of failures stays above the limit, with enough events, for ``hold`` windows
    on end. The windows are as many as the time covered has, whatever the number of events."""
    bad = windows.where((F.col("done") + F.col("failed") >= least) & (F.col("failed") > share * (F.col("done") + F.col("failed"))))
    n = F.row_number().over(Window.orderBy("start"))
    slot = F.floor(micros(F.col("start")) / (15 * 60 * 1_000_000))
    islands = bad.withColumn("g", slot - n).groupBy("g").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("windows"))
    return islands.where(F.col("windows") >= hold).select("start", "windows")


def retained(events: DataFrame, cutoff: str) -> DataFrame:
    """Events that stay: terminal ones only from the cutoff on, others always."""
    return events.where(~state(F.col("event_type")).isin(*TERMINAL) | (F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz")))


def transitions(events: DataFrame) -> DataFrame:
    """``from_state, to_state, n``: how often a tenant's state of a day changes into which."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    e = events.withColumn("to_state", state(F.col("event_type"))).withColumn("from_state", F.lag("to_state").over(w))
    return e.groupBy(F.coalesce("from_state", F.lit("none")).alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))


def overdue(events: DataFrame, seconds: int) -> DataFrame:
    """``event_id, late``: started work and whether the next terminal event of its tenant and day comes after the deadline or never."""
    s = state(F.col("event_type"))
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    e = events.withColumn("s", s).withColumn("end", F.min(F.when(s.isin(*TERMINAL), F.col("ts"))).over(w))
    return e.where(F.col("s") == "running").select("event_id", (F.col("end").isNull() | (micros(F.col("end")) - micros(F.col("ts")) > seconds * 1_000_000)).alias("late"))


def final_states(events: DataFrame) -> DataFrame:
    """``user_id, day, state``: the last state of each tenant and day; a terminal state stays once reached, events after it are ignored."""
    s = state(F.col("event_type"))
    e = events.select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id").alias("at"), s.alias("s"))
    return e.groupBy("user_id", "day").agg(F.coalesce(F.min_by(F.when(F.col("s").isin(*TERMINAL), F.col("s")), F.when(F.col("s").isin(*TERMINAL), F.col("at"))), F.max_by("s", "at")).alias("state"))


def busy_intervals(events: DataFrame) -> DataFrame:
    """``user_id, day, start_us, end_us, n``: union of the intervals that a tenant's events of a day occupy, their value in minutes."""
    i = events.select("user_id", F.to_date("ts").alias("day"), "event_id", micros(F.col("ts")).alias("a"), (micros(F.col("ts")) + (F.col("value") * 60e6).cast("bigint")).alias("b"))
    w = Window.partitionBy("user_id", "day").orderBy("a", "event_id")
    seen = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    i = i.withColumn("new", F.when(seen.isNull() | (F.col("a") > seen), 1).otherwise(0)).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("user_id", "day", "g").agg(F.min("a").alias("start_us"), F.max("b").alias("end_us"), F.count(F.lit(1)).alias("n")).drop("g")


# --- streams


def read_events(spark: SparkSession, sf: str, lateness: str = "1 hour") -> DataFrame:
    """The events as a stream of files; their zoneless times become instants, as watermarks need."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    r = spark.readStream.schema(schema)
    # a stream reads folders: that of the table, or the one that holds its only file
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    source = r.parquet(path) if folder else r.option("pathGlobFilter", "events.parquet").parquet(sf)
    return source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote; a failed run starts again from its checkpoint."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again writes the same folder again
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={batch_id}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.drop("batch") if mode != "complete" else out


def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return drained(metrics(read_events(spark, sf)))


def stream_once(spark: SparkSession, sf: str) -> DataFrame:
    """Each event once, also if it is delivered again within the watermark."""
    e = read_events(spark, sf)
    return drained(e.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"), "append")


def stream_states(spark: SparkSession, sf: str) -> DataFrame:
    """``user_id, done, failed, ignored``: a job machine for each tenant with its own state: work ends when it is done or
    fails, and events until the next start are ignored."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        open_, done, failed, ignored = held.get if held.exists else (0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows.event_type:
            s = STATES.get(kind)
            if s == "queued":
                open_ = 1
            elif not open_:
                ignored += 1
            elif s in TERMINAL:
                open_, done, failed = 0, done + (s == "done"), failed + (s == "failed")
        held.update((open_, done, failed, ignored))
        yield pd.DataFrame({"user_id": [key[0]], "done": [done], "failed": [failed], "ignored": [ignored]})

    e = read_events(spark, sf).select("user_id", "ts", "event_id", "event_type")
    s = e.groupBy("user_id").applyInPandasWithState(advance, "user_id bigint, done bigint, failed bigint, ignored bigint", "open bigint, done bigint, failed bigint, ignored bigint", "update", "NoTimeout")
    out = drained(s, "update")
    # the last of a tenant's updates has the greatest counts
    return out.groupBy("user_id").agg(F.max("done").alias("done"), F.max("failed").alias("failed"), F.max("ignored").alias("ignored"))


def prometheus(windows: DataFrame) -> DataFrame:
    """``line``: gauges as text, one for each state and window start."""
    stamp = F.unix_timestamp("start")
    return windows.select(F.explode(F.array(*[F.concat(F.lit(f'jobs_total{{state="{k}"}} '), F.col(k).cast("string"), F.lit(" "), stamp.cast("string"), F.lit("000")) for k in ("done", "failed")])).alias("line"))



def restarted(events: DataFrame) -> DataFrame:
    """``user_id, day, state``: the jobs as a restart finds them: what is neither done nor failed was interrupted and has
    failed; nothing is tried again."""
    f = final_states(events)
    return f.withColumn("state", F.when(F.col("state").isin(*TERMINAL), F.col("state")).otherwise("failed"))


def cancelled(events: DataFrame, controls: DataFrame) -> DataFrame:
    """``user_id, day, state``: jobs with the state they have when they are told to stop, queued or running; what has
    ended before stays as it is. Controls have user_id, day and at, the time of the first order."""
    c = controls.groupBy("user_id", "day").agg(F.min("at").alias("at"))
    e = events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", state(F.col("event_type")).alias("s")).join(c, ["user_id", "day"]).where(F.col("ts") <= F.col("at"))
    s = e.groupBy("user_id", "day").agg(F.bool_or(F.col("s").isin(*TERMINAL)).alias("over"), F.max_by("s", F.struct("ts", "event_id")).alias("s"))
    return s.where(~F.col("over")).select("user_id", "day", F.col("s").alias("state"))


def stage_times(events: DataFrame) -> DataFrame:
    """``event_type, n, total_us``: how long jobs stay in each stage, up to their next event."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    t = events.select("event_type", (micros(F.lead("ts").over(w)) - micros(F.col("ts"))).alias("us"))
    return t.where(F.col("us").isNotNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("us").alias("total_us"))


def log_lines(events: DataFrame, extras: list[str]) -> DataFrame:
    """``event_id, line``: each event as a line of JSON with its type and those of its properties that are let through."""
    own = [F.get_json_object("props", f"$.{e}").alias(e) for e in extras]
    return events.select("event_id", F.to_json(F.struct(F.col("event_id"), F.col("event_type").alias("event"), *own)).alias("line"))


def newest_first(events: DataFrame) -> DataFrame:
    """``event_id, place``: the jobs of a tenant and day, the newest first."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.select("event_id", F.row_number().over(w).alias("place"))
