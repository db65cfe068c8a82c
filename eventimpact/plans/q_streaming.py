"""Batch twins of the streaming operators (R01–R05, R07), checked against SQL; the streams themselves are
tested in tests/test_streaming.py against these twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as X
from ..streaming import live as L
from .registry import query

NOW = X.INC_NOW

SLIDE_SQL = """
sw AS (SELECT i.*, make_timestamp(CAST((epoch_us(start_datetime) // 900000000 - t.wk) * 900000000 AS BIGINT)) AS window_start
       FROM inc i, unnest(range(0, 8)) t(wk)),
swe AS (SELECT *, window_start + INTERVAL 2 HOUR AS window_end FROM sw)"""


@query("active_incidents", f"""
SELECT id, start_datetime, event_cause, corridor, requires_road_closure FROM inc
WHERE start_datetime > TIMESTAMP '{NOW}' - INTERVAL 2 HOUR AND start_datetime <= TIMESTAMP '{NOW}'""")
def q_active_incidents(spark, sf):
    """R01 batch twin: event time strictly within the last 2 h before ``now``."""
    d = X.inc(spark, sf).select("id", "start_datetime", "event_cause", "corridor", "requires_road_closure")
    return L.active_at(d, NOW, 2)


@query("system_pulse", f"""
WITH {SLIDE_SQL}
SELECT CAST(window_start AS TIMESTAMP) AS window_start, CAST(window_end AS TIMESTAMP) AS window_end,
  count(*) AS total_active_incidents, CAST(sum(CASE WHEN requires_road_closure = 1 THEN 1 ELSE 0 END) AS BIGINT) AS critical_incidents,
  max(start_datetime) AS last_incident_time,
  CASE WHEN sum(CASE WHEN requires_road_closure = 1 THEN 1 ELSE 0 END) > 2 THEN 'Critical' WHEN count(*) > 5 THEN 'Warning' ELSE 'Normal' END AS system_status
FROM swe GROUP BY window_start, window_end""")
def q_system_pulse(spark, sf):
    """2 h windows sliding by 15 min."""
    return L.system_pulse(X.inc(spark, sf))


@query("traffic_conditions", f"""
WITH {SLIDE_SQL},
cor AS (SELECT 'Non-corridor' AS corridor UNION ALL SELECT concat('C', CAST(i AS VARCHAR)) FROM range(0, 7) t(i)),
k AS (SELECT window_start, window_end, corridor, count(*) AS n FROM swe GROUP BY window_start, window_end, corridor),
g AS (SELECT w.window_start, w.window_end, cor.corridor, coalesce(k.n, 0) AS active_incidents
      FROM (SELECT DISTINCT window_start, window_end FROM swe) w CROSS JOIN cor
      LEFT JOIN k ON w.window_start = k.window_start AND cor.corridor = k.corridor),
b AS (SELECT *, CASE WHEN hour(window_end) IN (8, 9, 17, 18, 19) AND (isodow(window_end) - 1) NOT IN (5, 6) THEN 70
                     WHEN hour(window_end) IN (8, 9, 17, 18, 19) THEN 50 WHEN (isodow(window_end) - 1) IN (5, 6) THEN 20 ELSE 30 END AS base FROM g),
c AS (SELECT *, CAST(CASE WHEN active_incidents > 0 THEN least(100, base + active_incidents * 15) ELSE base END AS INT) AS congestion_level FROM b)
SELECT window_start, window_end, corridor, active_incidents, congestion_level,
  CASE WHEN congestion_level >= 70 THEN 'Heavy' WHEN congestion_level >= 40 THEN 'Moderate' ELSE 'Light' END AS status,
  greatest(10.0, 60 - 0.5 * congestion_level) AS avg_speed_kmph FROM c""")
def q_traffic_conditions(spark, sf):
    """Every corridor of the fixture dimension in every window, quiet ones included."""
    return L.traffic_conditions(X.inc(spark, sf), X.CORRIDORS)


@query("traffic_conditions_always", """
WITH m AS (SELECT epoch_us(min(start_datetime)) // 900000000 * 900000000 - 6300000000 AS lo, epoch_us(max(start_datetime)) // 900000000 * 900000000 AS hi FROM inc),
w AS (SELECT make_timestamp(CAST(lo + i * 900000000 AS BIGINT)) AS window_start FROM m, unnest(range(0, CAST((hi - lo) // 900000000 AS BIGINT) + 1)) t(i)),
cor AS (SELECT 'Non-corridor' AS corridor UNION ALL SELECT concat('C', CAST(i AS VARCHAR)) FROM range(0, 7) t(i)),
k AS (SELECT make_timestamp(CAST((epoch_us(start_datetime) // 900000000 - t.wk) * 900000000 AS BIGINT)) AS window_start, corridor, count(*) AS n
      FROM inc, unnest(range(0, 8)) t(wk) GROUP BY 1, 2),
g AS (SELECT w.window_start, w.window_start + INTERVAL 2 HOUR AS window_end, cor.corridor, coalesce(k.n, 0) AS active_incidents
      FROM w CROSS JOIN cor LEFT JOIN k ON w.window_start = k.window_start AND cor.corridor = k.corridor),
b AS (SELECT *, CASE WHEN hour(window_end) IN (8, 9, 17, 18, 19) AND (isodow(window_end) - 1) NOT IN (5, 6) THEN 70
                     WHEN hour(window_end) IN (8, 9, 17, 18, 19) THEN 50 WHEN (isodow(window_end) - 1) IN (5, 6) THEN 20 ELSE 30 END AS base FROM g),
c AS (SELECT *, CAST(CASE WHEN active_incidents > 0 THEN least(100, base + active_incidents * 15) ELSE base END AS INT) AS congestion_level FROM b)
SELECT window_start, window_end, corridor, active_incidents, congestion_level,
  CASE WHEN congestion_level >= 70 THEN 'Heavy' WHEN congestion_level >= 40 THEN 'Moderate' ELSE 'Light' END AS status,
  greatest(10.0, 60 - 0.5 * congestion_level) AS avg_speed_kmph FROM c""")
def q_traffic_conditions_always(spark, sf):
    """Every corridor in every window of the time that the table spans, also while the whole city is quiet."""
    return L.traffic_conditions_always(X.inc(spark, sf), X.CORRIDORS)


@query("pulse_breakdown", f"""
WITH {SLIDE_SQL}
SELECT window_start, window_end, event_cause, count(*) AS n FROM swe GROUP BY window_start, window_end, event_cause""")
def q_pulse_breakdown(spark, sf):
    """Active incidents by cause per window."""
    return L.pulse_breakdown(X.inc(spark, sf))


@query("tumbling_hourly", """
SELECT date_trunc('hour', start_datetime) AS window_start, date_trunc('hour', start_datetime) + INTERVAL 1 HOUR AS window_end,
  corridor, event_cause, count(*) AS n FROM inc GROUP BY 1, 2, corridor, event_cause""")
def q_tumbling_hourly(spark, sf):
    """R05."""
    return L.tumbling_hourly(X.inc(spark, sf))


def lifecycle_events(spark, sf):
    """Report at the start, resolve at start + duration (when known): the incident status feed (ours)."""
    d = X.inc(spark, sf)
    base = d.select("id", F.col("start_datetime").cast("timestamp").alias("ts"), F.lit("report").alias("kind"), "corridor",
                    F.col("event_cause").alias("cause"), F.col("requires_road_closure").alias("closure"))
    res = d.filter(F.col("duration_minutes").isNotNull()).select(
        "id", F.timestamp_micros(F.unix_micros(F.col("start_datetime").cast("timestamp"))
                                 + F.round(F.col("duration_minutes") * 60000000).cast("long")).alias("ts"),
        F.lit("resolve").alias("kind"), "corridor", F.col("event_cause").alias("cause"),
        F.col("requires_road_closure").alias("closure"))
    return base.unionByName(res)


@query("incident_status", f"""
WITH ev AS (SELECT id, start_datetime AS ts, 'report' AS kind FROM inc
            UNION ALL SELECT id, make_timestamp(epoch_us(start_datetime) + CAST(round(duration_minutes * 60000000) AS BIGINT)), 'resolve'
            FROM inc WHERE duration_minutes IS NOT NULL)
SELECT id, arg_max(kind, ts) AS status, max(ts) AS as_of FROM ev WHERE ts <= TIMESTAMP '{NOW}' GROUP BY id""")
def q_incident_status(spark, sf):
    """R04 batch twin: latest status per incident as of ``now``."""
    return L.status_as_of(lifecycle_events(spark, sf), NOW)


@query("dedup_events", """
WITH rep AS (SELECT id, start_datetime, event_cause FROM inc
             UNION ALL SELECT id, start_datetime + INTERVAL 5 MINUTE, event_cause FROM inc WHERE requires_road_closure = 1)
SELECT id, min(start_datetime) AS start_datetime, arg_min(event_cause, start_datetime) AS event_cause FROM rep GROUP BY id""")
def q_dedup_events(spark, sf):
    """R07 batch twin: closure incidents are re-reported 5 min later; the first report per id is kept."""
    d = X.inc(spark, sf)
    rep = d.select("id", "start_datetime", "event_cause").unionByName(
        d.filter(F.col("requires_road_closure") == 1).select(
            "id", (F.col("start_datetime") + F.expr("INTERVAL 5 MINUTES")).alias("start_datetime"), "event_cause"))
    return L.first_reports(rep)
