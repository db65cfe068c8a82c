"""Live incident monitoring with Structured Streaming.

The reference keeps its live list in process memory; here the feed is a stream (a landed-file source; Kafka is a
drop-in format) and all live state sits in Spark's checkpointed state store:

* windowed aggregates (pulse, traffic, hourly counts) are the same function for a batch frame (the "batch twin"
  checked against SQL) and a watermarked stream (append mode emits each window once it is final);
* duplicate reports are dropped with ``dropDuplicatesWithinWatermark``;
* the per-incident lifecycle (open → resolved / expired) is keyed state (``transformWithState``) with event-time
  timers, so an incident ages out when the watermark passes ``first report + N hours``; the state is a table to read;
* predictions and late outcomes meet in a stream–stream left-outer join bounded by watermarks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from ..functions.rules import congestion_speed
from ..sources.files import path_exists

INCIDENT_EVENT_SCHEMA = "id long, ts timestamp, kind string, corridor string, cause string, closure int"


def active_at(df: DataFrame, now: str, hours: int = 2, ts: str = "start_datetime") -> DataFrame:
    """R01 batch twin: incidents whose event time is strictly within the last ``hours`` before ``now``."""
    t = F.col(ts).cast("timestamp")
    n = F.lit(now).cast("timestamp")
    return df.filter((t > n - F.make_interval(hours=F.lit(hours))) & (t <= n))


def _flat_window(g: DataFrame) -> DataFrame:
    return g.withColumn("window_start", F.col("window.start")).withColumn("window_end", F.col("window.end")).drop("window")


def system_pulse(df: DataFrame, ts: str = "start_datetime", length: str = "2 hours", slide: str = "15 minutes") -> DataFrame:
    """Per sliding window — active count, closures, last event time and status
    (closures > 2 Critical; active > 5 Warning; else Normal). Works on batch and watermarked streams."""
    g = df.groupBy(F.window(ts, length, slide)).agg(
        F.count(F.lit(1)).alias("total_active_incidents"),
        F.sum(F.when(F.col("requires_road_closure") == 1, 1).otherwise(0)).cast("long").alias("critical_incidents"),
        F.max(ts).alias("last_incident_time"))
    st = (F.when(F.col("critical_incidents") > 2, "Critical").when(F.col("total_active_incidents") > 5, "Warning")
          .otherwise("Normal"))
    return _flat_window(g.withColumn("system_status", st))


def pulse_breakdown(df: DataFrame, ts: str = "start_datetime", length: str = "2 hours", slide: str = "15 minutes") -> DataFrame:
    """Incident breakdown by cause per sliding window."""
    return _flat_window(df.groupBy(F.window(ts, length, slide), "event_cause").agg(F.count(F.lit(1)).alias("n")))


def base_congestion(hour: Column, weekday: Column) -> Column:
    """70 rush weekday, 50 rush weekend, 20 weekend, else 30 (rush = {8, 9, 17, 18, 19}); jitter dropped."""
    rush = hour.isin(8, 9, 17, 18, 19)
    wkend = weekday.isin(5, 6)
    return F.when(rush & ~wkend, 70).when(rush & wkend, 50).when(wkend, 20).otherwise(30)


def traffic_conditions(df: DataFrame, corridors: list[str], ts: str = "start_datetime", length: str = "2 hours",
                       slide: str = "15 minutes") -> DataFrame:
    """Per sliding window and corridor of the fixed dimension ``corridors``, as seen at the window end:
    congestion (+15 per active incident, capped at 100, only when there are incidents), status, speed.

    One aggregate per window counts every corridor, so a corridor without an incident is answered too, and the same
    plan serves a batch and a watermarked stream (no join against the dimension). Other corridors, null too, are grouped
    and answered in the windows where they have incidents."""
    counts = [F.count(F.when(F.col("corridor") == c, 1)).alias(f"__n{i}") for i, c in enumerate(corridors)]
    g = _flat_window(df.groupBy(F.window(ts, length, slide)).agg(*counts))
    rows = F.array(*[F.struct(F.lit(c).alias("corridor"), F.col(f"__n{i}").alias("active_incidents")) for i, c in enumerate(corridors)])
    g = g.select("window_start", "window_end", F.explode(rows).alias("c")).select("window_start", "window_end", "c.*")
    others = df.filter(~F.coalesce(F.col("corridor").isin(corridors), F.lit(False)))
    others = _flat_window(others.groupBy(F.window(ts, length, slide), "corridor").agg(F.count(F.lit(1)).alias("active_incidents")))
    g = g.unionByName(others.select(*g.columns))
    end = F.col("window_end")
    base = base_congestion(F.hour(end), F.weekday(end))
    n = F.col("active_incidents")
    cong = F.when(n > 0, F.least(F.lit(100), base + n * 15)).otherwise(base)
    g = g.withColumn("congestion_level", cong.cast("int"))
    c = F.col("congestion_level")
    return g.withColumn("status", F.when(c >= 70, "Heavy").when(c >= 40, "Moderate").otherwise("Light")) \
            .withColumn("avg_speed_kmph", congestion_speed(c.cast("double")))


def traffic_conditions_always(df: DataFrame, corridors: list[str], ts: str = "start_datetime", length_minutes: int = 120,
                              slide_minutes: int = 15) -> DataFrame:
    """R03 for every window from the first incident to the last, also those in which no corridor has one, and every
    corridor of the dimension (other corridors as ``traffic_conditions`` answers them). The windows are a sequence of the
    slide, so their number grows with the time that the table spans."""
    got = traffic_conditions(df, corridors, ts, f"{length_minutes} minutes", f"{slide_minutes} minutes")
    us, slide, length = F.unix_micros(F.col(ts).cast("timestamp")), slide_minutes * 60_000_000, length_minutes * 60_000_000
    span = df.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).filter("lo is not null")
    first = F.floor(F.col("lo") / slide).cast("long") * slide - (length - slide)
    starts = span.select(F.explode(F.sequence(first, F.floor(F.col("hi") / slide).cast("long") * slide, F.lit(slide).cast("long"))).alias("us"))
    names = F.explode(F.array(*[F.lit(c) for c in corridors])).alias("corridor")
    grid = starts.select(F.timestamp_micros("us").alias("window_start"), F.timestamp_micros(F.col("us") + length).alias("window_end"), names)
    grid = grid.select(*[F.col(c).alias(f"__{c}") for c in grid.columns])
    cast = got.withColumns({c: F.col(c).cast("timestamp") for c in ("window_start", "window_end")})
    quiet = grid.join(cast, (F.col("window_start") == F.col("__window_start")) & (F.col("corridor") == F.col("__corridor")), "left_anti")
    base = base_congestion(F.hour("__window_end"), F.weekday("__window_end")).cast("int")
    quiet = quiet.select(F.col("__window_start").alias("window_start"), F.col("__window_end").alias("window_end"), F.col("__corridor").alias("corridor"),
                         F.lit(0).cast("long").alias("active_incidents"), base.alias("congestion_level"))
    c = F.col("congestion_level")
    quiet = quiet.withColumn("status", F.when(c >= 70, "Heavy").when(c >= 40, "Moderate").otherwise("Light")).withColumn(
        "avg_speed_kmph", congestion_speed(c.cast("double")))
    return cast.unionByName(quiet)


def tumbling_hourly(df: DataFrame, ts: str = "start_datetime") -> DataFrame:
    """Tumbling hourly counts per corridor and cause."""
    return _flat_window(df.groupBy(F.window(ts, "1 hour"), "corridor", "event_cause").agg(F.count(F.lit(1)).alias("n")))


def dedup_reports(stream: DataFrame, key: str = "id", ts: str = "start_datetime", watermark: str = "2 hours") -> DataFrame:
    """Drop repeated reports of the same incident id within the watermark (state is bounded by it)."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def first_reports(df: DataFrame, key: str = "id", ts: str = "start_datetime") -> DataFrame:
    """R07 batch twin: earliest report per id."""
    others = [c for c in df.columns if c not in (key, ts)]
    g = df.groupBy(key).agg(F.min(F.struct(F.col(ts), *[F.col(c) for c in others])).alias("__f"))
    return g.select(key, F.col(f"__f.{ts}").alias(ts), *[F.col(f"__f.{c}").alias(c) for c in others])


def status_as_of(events: DataFrame, now: str, key: str = "id", ts: str = "ts") -> DataFrame:
    """R04 batch twin: latest status per incident among events at or before ``now`` (``max_by``)."""
    e = events.filter(F.col(ts) <= F.lit(now).cast("timestamp"))
    return e.groupBy(key).agg(F.max_by("kind", ts).alias("status"), F.max(ts).alias("as_of"))


LIFECYCLE_OUT = "id long, status string, first_ts timestamp, resolved_ts timestamp, corridor string, cause string"
LIFECYCLE_STATE = "first_us long, resolved_us long, pending_us long, corridor string, cause string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """State of one incident: first report, its resolve, and the latest resolve that has no report yet. An event-time
    timer at first report (or waiting resolve) + ``max_age_hours`` clears it. The rows of a micro-batch are reduced by
    minima and maxima, whatever their order."""

    def __init__(self, max_age_hours: int):
        self.age_us = max_age_hours * 3_600_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("incident", LIFECYCLE_STATE)

    def answer(self, key, status, first, resolved, corridor, cause):
        at = lambda us: pd.Timestamp(us, unit="us") if us is not None else pd.NaT
        return pd.DataFrame({"id": [key[0]], "status": [status], "first_ts": [at(first)], "resolved_ts": [at(resolved)], "corridor": [corridor],
                             "cause": [cause]})

    def handleInputRows(self, key, rows, timerValues):
        first, resolved, pending, corridor, cause = self.state.get() if self.state.exists() else (None,) * 5
        asked = False
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            reports, resolves = us[pdf["kind"] == "report"], us[pdf["kind"] == "resolve"]
            if len(reports) and (first is None or reports.min() < first):
                at = reports.idxmin()
                first, corridor, cause = int(us[at]), pdf["corridor"][at], pdf["cause"][at]
            if len(resolves):
                asked = True
                pending = max(pending if pending is not None else -1, int(resolves.max()))
                if first is not None and resolved is None and (resolves >= first).any():
                    resolved = int(resolves[resolves >= first].min())
        if first is not None and resolved is None and pending is not None and pending >= first:
            resolved = pending
        self.state.update((first, resolved, pending, corridor, cause))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(((first if first is not None else pending) + self.age_us) // 1000)
        if first is None and asked:                       # resolve of an id that nobody has reported: not found
            yield self.answer(key, "unknown", None, None, None, None)
        elif first is not None:
            yield self.answer(key, "resolved" if resolved is not None else "open", first, resolved, corridor, cause)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        first, resolved, _, corridor, cause = self.state.get() if self.state.exists() else (None,) * 5
        self.state.clear()
        if first is not None:
            yield self.answer(key, "expired", first, resolved, corridor, cause)

    def close(self) -> None:
        pass


def incident_lifecycle(events: DataFrame, max_age_hours: int = 2, watermark: str = "2 hours") -> DataFrame:
    """Keyed state per incident id (``transformWithState``) — open on the first report, resolved on the
    first resolve (also one that lands in an earlier micro-batch than its report), unknown where a resolve finds no
    report, expired (state removed) once the watermark passes first report + ``max_age_hours``. Late rows behind the
    watermark are dropped by Spark; ``split_late`` keeps them."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return events.withWatermark("ts", watermark).groupBy("id").transformWithStateInPandas(
        statefulProcessor=Lifecycle(max_age_hours), outputStructType=LIFECYCLE_OUT, outputMode="Update", timeMode="EventTime")


def live_states(spark, checkpoint: str) -> DataFrame:
    """The lifecycle's state as a table, read from its checkpoint: id, first_ts, resolved_ts, corridor, cause."""
    s = spark.read.format("statestore").option("stateVarName", "incident").load(checkpoint)
    v = F.col("value")
    return s.select(F.col("key.id").alias("id"), F.timestamp_micros(v["first_us"]).alias("first_ts"),
                    F.timestamp_micros(v["resolved_us"]).alias("resolved_ts"), v["corridor"].alias("corridor"), v["cause"].alias("cause"))


def active_now(spark, checkpoint: str) -> DataFrame:
    """R01 from the state: reported, not resolved, not expired."""
    return live_states(spark, checkpoint).filter("first_ts is not null and resolved_ts is null")


def resolve_answers(requests: DataFrame, spark, checkpoint: str, key: str = "id") -> DataFrame:
    """R04 from the state: whether the incident of each request is known and open (unknown id: false)."""
    known = live_states(spark, checkpoint).filter("first_ts is not null").select(F.col("id").alias("__id"), F.col("resolved_ts").isNull().alias("__open"))
    j = requests.join(known, F.col(key) == F.col("__id"), "left")
    return j.select(*requests.columns, F.col("__id").isNotNull().alias("found"), F.coalesce("__open", F.lit(False)).alias("can_resolve"))


def split_late(path: str, ts: str = "ts", delay: str = "2 hours"):
    """A ``foreachBatch`` function that writes rows behind the watermark to ``path``/late and all others to
    ``path``/on_time; together they are the input. The watermark of a batch is the latest event time of the batches
    before it, less ``delay``; each batch lands its own latest time under its number. All folders carry the batch number
    and are overwritten, so a replayed batch counts once."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark, marks = batch.sparkSession, f"{path}/latest"
        before = None
        if path_exists(spark, marks):
            before = spark.read.parquet(marks).filter(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
        rows = batch.withColumn("__late", F.lit(False) if before is None else F.coalesce(F.col(ts) < F.lit(before) - F.expr(f"INTERVAL {delay}"), F.lit(False)))
        for name, late in (("on_time", False), ("late", True)):
            rows.filter(F.col("__late") == late).drop("__late").write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        batch.agg(F.max(ts).alias("latest")).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")
    return fn


class ProgressLog(StreamingQueryListener):
    """Lands one row per micro-batch (input rows, rows dropped behind the watermark, rows of state) as Parquet."""

    SCHEMA = "query string, batch_id long, input_rows long, dropped_rows long, state_rows long, watermark string"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        ops = p.stateOperators
        row = (p.name or str(p.id), int(p.batchId), int(p.numInputRows), sum(int(o.numRowsDroppedByWatermark) for o in ops),
               sum(int(o.numRowsTotal) for o in ops), (p.eventTime or {}).get("watermark"))
        self.spark.createDataFrame([row], self.SCHEMA).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def predictions_with_outcomes(predictions: DataFrame, outcomes: DataFrame, wait: str = "7 days") -> DataFrame:
    """stream–stream left-outer join; an outcome counts if it arrives within ``wait`` after the prediction."""
    p = predictions.withWatermark("pred_ts", "1 day").alias("p")
    o = outcomes.withWatermark("outcome_ts", "1 day").alias("o")
    cond = ((F.col("p.prediction_id") == F.col("o.outcome_prediction_id"))
            & (F.col("o.outcome_ts") >= F.col("p.pred_ts"))
            & (F.col("o.outcome_ts") <= F.col("p.pred_ts") + F.expr(f"INTERVAL {wait}")))
    return p.join(o, cond, "leftOuter")


def drift_monitor(log_path: str, now_col: str = "ts", window_days: int = 30):
    """A ``foreachBatch`` function that logs each micro-batch and writes the drift status (M24) after it.

    Every output folder carries the batch number and is overwritten, so a replayed micro-batch counts once. A batch
    adds one row of partial sums per day; the status sums the days that lie inside the window as a whole and reads
    the log of the one day that the window cuts, not the whole log."""
    from ..operators.feedback import drift_status, error_sums, with_errors

    def fn(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        rows = with_errors(batch).withColumn("day", F.to_date(now_col))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{log_path}/log/batch_id={batch_id}")
        spark.read.parquet(f"{log_path}/log/batch_id={batch_id}").groupBy("day").agg(
            F.max(now_col).alias("last"), *error_sums()).write.mode("overwrite").parquet(f"{log_path}/days/batch_id={batch_id}")
        days = spark.read.parquet(f"{log_path}/days")
        now = days.agg(F.max("last")).first()[0]
        cutoff = F.lit(now) - F.make_interval(days=F.lit(window_days))
        edge = spark.read.parquet(f"{log_path}/log").filter((F.col("day") == F.to_date(cutoff)) & (F.col(now_col) > cutoff))
        sums = [c for c in days.columns if c not in ("day", "last", "batch_id")]
        parts = days.filter(F.col("day") > F.to_date(cutoff)).select(*sums).unionByName(edge.agg(*error_sums()).select(*sums))
        drift_status(parts.agg(*[F.sum(c).alias(c) for c in sums]), window_days).write.mode("overwrite").parquet(
            f"{log_path}/drift/batch_id={batch_id}")

    return fn


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger_once: bool = True):
    """Parquet sink with a checkpoint (exactly-once file sink; restarts resume from the checkpoint)."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
