"""Streams (file source + availableNow) give the same result as their SQL-checked batch twins."""

import datetime
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from eventimpact.plans import q_streaming as QS
from eventimpact.sources import fixtures as X
from eventimpact.streaming import live as L


def _land(df, parts=4):
    d = tempfile.mkdtemp(prefix="ei-stream-src-")
    df.repartition(parts).write.mode("overwrite").parquet(d)
    return d


def _run(stream_df, mode="append", name=None):
    name = name or f"q{abs(hash(str(stream_df.schema))) % 10**8}"
    ck = tempfile.mkdtemp(prefix="ei-ck-")
    q = (stream_df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(300)
    return stream_df.sparkSession.table(name), q


def _same(a, b, cols):
    ra = sorted(tuple(r) for r in a.select(*cols).collect())
    rb = sorted(tuple(r) for r in b.select(*cols).collect())
    assert ra == rb


def test_dedup_stream_equals_first_reports(spark):
    d = X.inc(spark, SF_SMALL)
    rep = d.select("id", "start_datetime", "event_cause").unionByName(
        d.filter(F.col("requires_road_closure") == 1).select(
            "id", (F.col("start_datetime") + F.expr("INTERVAL 5 MINUTES")).alias("start_datetime"), "event_cause"))
    src = _land(rep.withColumn("start_datetime", F.col("start_datetime").cast("timestamp")))
    stream = spark.readStream.schema("id long, start_datetime timestamp, event_cause string").parquet(src)
    out, _ = _run(L.dedup_reports(stream), name="dedup_t")
    twin = L.first_reports(rep.withColumn("start_datetime", F.col("start_datetime").cast("timestamp")))
    # within-watermark dedup keeps the first *arriving* report; across files both copies can arrive in one batch,
    # so compare ids (every id exactly once)
    assert out.count() == twin.count() == out.select("id").distinct().count()


def test_pulse_stream_equals_batch_twin(spark):
    d = X.inc(spark, SF_SMALL).withColumn("start_datetime", F.col("start_datetime").cast("timestamp"))
    src = _land(d.select("id", "start_datetime", "requires_road_closure", "event_cause", "corridor"))
    stream = spark.readStream.schema(
        "id long, start_datetime timestamp, requires_road_closure int, event_cause string, corridor string").parquet(src)
    out, _ = _run(L.system_pulse(stream), mode="complete", name="pulse_t")
    twin = L.system_pulse(d)
    _same(out, twin, ["window_start", "total_active_incidents", "critical_incidents", "system_status"])


def test_tumbling_append_emits_only_closed_windows(spark):
    d = X.inc(spark, SF_SMALL).withColumn("start_datetime", F.col("start_datetime").cast("timestamp"))
    src = _land(d.select("id", "start_datetime", "event_cause", "corridor"))
    stream = spark.readStream.schema("id long, start_datetime timestamp, event_cause string, corridor string").parquet(src)
    out, _ = _run(L.tumbling_hourly(stream.withWatermark("start_datetime", "1 hour")), mode="append", name="tumble_t")
    twin = L.tumbling_hourly(d)
    got = {tuple(r) for r in out.select("window_start", "corridor", "event_cause", "n").collect()}
    want = {tuple(r) for r in twin.select("window_start", "corridor", "event_cause", "n").collect()}
    assert got and got <= want          # every emitted window is final and exact


def _feed(spark, parts):
    """Events landed as one file each, in order."""
    src = tempfile.mkdtemp(prefix="ei-life-")
    for rows in parts:
        df = spark.createDataFrame(rows, "id long, ts string, kind string, corridor string, cause string, closure int")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)                                            # the file source takes files by time
    return spark.readStream.schema(L.INCIDENT_EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def _lifecycle(spark, parts, name):
    ck = tempfile.mkdtemp(prefix="ei-life-ck-")
    q = (L.incident_lifecycle(_feed(spark, parts)).writeStream.format("memory").queryName(name).outputMode("update")
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(300)
    return spark.table(name).collect(), ck


def test_lifecycle_state_open_resolved_expired(spark):
    day = "2024-01-01 "
    parts = [[(1, day + "08:00:00", "report", "C1", "accident", 0), (1, day + "08:30:00", "resolve", "C1", "accident", 0),
              (2, day + "08:10:00", "report", "C2", "protest", 1), (3, day + "08:20:00", "resolve", "C3", "tree_fall", 0),   # unknown id
              (5, day + "08:40:00", "resolve", "C5", "accident", 0)],
             [(5, day + "08:25:00", "report", "C5", "accident", 0)],                                                # its resolve came before
             [(4, day + "13:00:00", "report", "C4", "accident", 0)]]                                                # watermark → 11:00
    rows, ck = _lifecycle(spark, parts, "life_t")
    seen = {}
    for r in rows:
        seen.setdefault(r["id"], set()).add(r["status"])
    assert seen[1] == {"resolved", "expired"} and seen[2] == {"open", "expired"}
    assert seen[3] == {"unknown"} and seen[4] == {"open"} and seen[5] == {"unknown", "resolved", "expired"}
    assert [r["id"] for r in L.active_now(spark, ck).collect()] == [4]
    asked = spark.createDataFrame([(4,), (2,), (77,)], "id long")
    got = {r["id"]: (r["found"], r["can_resolve"]) for r in L.resolve_answers(asked, spark, ck).collect()}
    assert got == {4: (True, True), 2: (False, False), 77: (False, False)}


def test_active_now_equals_the_batch_twin(spark):
    """State after a day of the fixture's reports and resolves: what the batch rules call open and not yet expired."""
    ev = QS.lifecycle_events(spark, SF_SMALL).select("id", "ts", "kind", "corridor", "cause", "closure").orderBy("ts").limit(400)
    rows = [(r.id, str(r.ts), r.kind, r.corridor, r.cause, r.closure) for r in ev.collect()]
    _, ck = _lifecycle(spark, [rows[:200], rows[200:]], "life_day_t")
    got = {r["id"]: (r["first_ts"], r["resolved_ts"]) for r in L.live_states(spark, ck).filter("first_ts is not null").collect()}
    first, resolve = {}, {}
    for i, ts, kind, *_ in rows:
        t = datetime.datetime.fromisoformat(ts)
        (first if kind == "report" else resolve)[i] = t
    # the watermark of the last batch lets rows of the last batch expire only if they lie 2 h + 2 h behind its latest
    mark = max(datetime.datetime.fromisoformat(r[1]) for r in rows) - datetime.timedelta(hours=2)
    alive = {i: (t, resolve[i] if i in resolve and resolve[i] >= t else None) for i, t in first.items() if t + datetime.timedelta(hours=2) > mark}
    assert got == alive and L.active_now(spark, ck).count() == sum(v[1] is None for v in alive.values())


def test_on_time_and_late_rows_are_the_input(spark):
    base, ck, logged = (tempfile.mkdtemp(prefix=f"ei-{k}-") for k in ("split", "split-ck", "progress"))
    day = "2024-01-01 "
    parts = [[(1, day + "08:00:00", "report", "C1", "a", 0), (2, day + "10:00:00", "report", "C1", "a", 0)],
             [(3, day + "07:59:00", "report", "C1", "a", 0), (4, day + "08:00:00", "report", "C1", "a", 0), (5, day + "15:00:00", "report", "C1", "a", 0),
              (6, None, "report", "C1", "a", 0)],
             [(7, day + "12:59:59", "report", "C1", "a", 0), (8, day + "13:00:00", "report", "C1", "a", 0)]]
    fn = L.split_late(base)

    def twice(batch, n):                                           # a replayed batch counts once
        fn(batch, n)
        fn(batch, n)
    feed = _feed(spark, parts)
    feed.writeStream.foreachBatch(twice).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(300)
    late = sorted(r.id for r in spark.read.parquet(f"{base}/late").collect())
    on_time = sorted(r.id for r in spark.read.parquet(f"{base}/on_time").collect())
    assert late == [3, 7] and on_time == [1, 2, 4, 5, 6, 8]
    # the listener lands input, dropped and state rows of each batch (Spark drops by the watermark of the batch before)
    rows = os.path.join(logged, "rows")
    listener = L.ProgressLog(spark, rows)
    spark.streams.addListener(listener)
    try:
        counts = L.tumbling_hourly(feed.withColumnRenamed("cause", "event_cause").withWatermark("ts", "2 hours"), "ts")
        _run(counts, mode="update", name="late_counts_t")
        for _ in range(100):
            if os.path.exists(rows) and spark.read.parquet(rows).agg(F.sum("input_rows")).first()[0] == 8:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    told = spark.read.parquet(rows).agg(F.sum("input_rows").alias("n"), F.sum("dropped_rows").alias("d"), F.max("state_rows").alias("s")).first()
    assert told.n == 8 and 0 <= told.d <= len(late) and told.s > 0


def test_batch_status_twin_matches_rules(spark):
    ev = QS.lifecycle_events(spark, SF_SMALL)
    st = L.status_as_of(ev, X.INC_NOW)
    assert set(r["status"] for r in st.collect()) <= {"report", "resolve"}


def test_stream_stream_outer_join(spark):
    preds = spark.createDataFrame([(1, "2024-01-01 08:00:00", 40.0), (2, "2024-01-01 09:00:00", 60.0)],
                                  "prediction_id long, pred_ts string, predicted double").withColumn("pred_ts", F.to_timestamp("pred_ts"))
    outs = spark.createDataFrame([(1, "2024-01-02 08:00:00", 45.0), (2, "2024-01-20 09:00:00", 70.0)],
                                 "outcome_prediction_id long, outcome_ts string, actual double").withColumn("outcome_ts", F.to_timestamp("outcome_ts"))
    ps = spark.readStream.schema(preds.schema).parquet(_land(preds, 1))
    os_ = spark.readStream.schema(outs.schema).parquet(_land(outs, 1))
    out, _ = _run(L.predictions_with_outcomes(ps, os_), name="join_t")
    got = {r["prediction_id"]: r["actual"] for r in out.collect()}
    assert got.get(1) == 45.0           # within 7 days
    assert 2 not in got or got[2] is None  # late outcome never joins


def test_parquet_sink_with_checkpoint(spark):
    d = X.inc(spark, SF_SMALL).select("id", F.col("start_datetime").cast("timestamp").alias("start_datetime"))
    src = _land(d)
    base = tempfile.mkdtemp(prefix="ei-sink-")
    q = L.write_stream(spark.readStream.schema(d.schema).parquet(src), os.path.join(base, "out"), os.path.join(base, "ck"))
    q.awaitTermination(300)
    assert spark.read.parquet(os.path.join(base, "out")).count() == d.count()


def test_late_rows_are_dropped_and_drift_monitor(spark):
    # Rows older than the watermark are dropped from the windowed aggregate
    early = spark.createDataFrame([(1, "2024-01-01 10:00:00", 0, "accident", "C1")],
                                  "id long, start_datetime string, requires_road_closure int, event_cause string, corridor string")
    late = spark.createDataFrame([(2, "2024-01-01 05:00:00", 0, "accident", "C1")], early.schema)
    src = tempfile.mkdtemp(prefix="ei-late-")
    ck = tempfile.mkdtemp(prefix="ei-late-ck-")
    schema = "id long, start_datetime timestamp, requires_road_closure int, event_cause string, corridor string"
    progress = []
    for i, d in enumerate((early, late)):          # second run resumes from the checkpoint (watermark 09:00)
        d.withColumn("start_datetime", F.to_timestamp("start_datetime")).coalesce(1).write.mode("append").parquet(src)
        sink = os.path.join(ck, f"out{i}")
        q = (L.tumbling_hourly(spark.readStream.schema(schema).parquet(src).withWatermark("start_datetime", "1 hour"))
             .writeStream.foreachBatch(lambda b, _id, p=sink: b.write.mode("append").parquet(p)).outputMode("update")
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination(300)
        progress += q.recentProgress
    assert not os.path.exists(os.path.join(ck, "out1")) or spark.read.parquet(os.path.join(ck, "out1")).count() == 0
    dropped = sum(p["stateOperators"][0].get("numRowsDroppedByWatermark", 0) for p in progress if p["stateOperators"])
    assert dropped == 1
    # foreachBatch appends the log and recomputes drift per micro-batch
    log = spark.createDataFrame([(f"p{i}", f"2024-01-0{1 + i % 5} 08:00:00", 50.0, 52.0) for i in range(12)],
                                "prediction_id string, ts string, predicted_impact double, actual_impact double") \
        .withColumn("ts", F.to_timestamp("ts"))
    lsrc = _land(log, 2)
    base = tempfile.mkdtemp(prefix="ei-drift-")
    q2 = (spark.readStream.schema(log.schema).parquet(lsrc).writeStream.foreachBatch(L.drift_monitor(base))
          .option("checkpointLocation", os.path.join(base, "ck")).trigger(availableNow=True).start())
    q2.awaitTermination(300)
    drift = spark.read.parquet(os.path.join(base, "drift")).orderBy(F.desc("batch_id")).first()
    assert drift["status"] == "model_healthy" and drift["predictions_analyzed"] == 12


def test_conditions_of_unlisted_and_null_corridors(spark):
    rows = [("C0", "2024-01-01 10:00:00"), ("new", "2024-01-01 10:00:00"), ("new", "2024-01-01 10:05:00"), (None, "2024-01-01 10:01:00")]
    d = spark.createDataFrame(rows, "corridor string, t string").select("corridor", F.col("t").cast("timestamp").alias("start_datetime"))
    got = L.traffic_conditions(d, ["C0", "C1"], length="1 hour", slide="1 hour").collect()
    assert {(r.corridor, r.active_incidents) for r in got} == {("C0", 1), ("C1", 0), ("new", 2), (None, 1)} and len(got) == 4
