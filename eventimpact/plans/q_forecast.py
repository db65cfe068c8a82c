"""Planned-event queries (M11–M17, J08, J09, J10, W08, D10, N08, U03) over ``plan`` with ``inc`` history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..sources import dims as D
from ..sources import fixtures as X
from .oracle import sql_case_map
from .registry import query

NOW = X.PLAN_NOW


def _events(spark, sf):
    p = X.plan(spark, sf)
    txt = F.concat_ws(" ", F.col("event_date").cast("string"), F.format_string("%02d:00", F.col("hour")))
    return p.withColumn("event_datetime", F.to_timestamp(txt, "yyyy-MM-dd HH:mm"))


def _history(spark, sf):
    return X.inc(spark, sf).withColumn("resolution_time_hours", F.col("duration_minutes") / 60)


def _scored_events(spark, sf):
    """Score and class only: the reports below use nothing of the similar history."""
    return FC.event_score(_events(spark, sf))


def _forecast(spark, sf):
    return FC.event_forecast(_events(spark, sf), _history(spark, sf))


SEV = f"coalesce({sql_case_map('event_type', D.CAUSE_SEVERITY)}, 5)"
CROWD_TIER = "CASE WHEN expected_crowd <= 10000 THEN 0 WHEN expected_crowd <= 30000 THEN 1 WHEN expected_crowd <= 50000 THEN 2 ELSE 3 END"
SCORE_SQL = f"""CAST(least(100, greatest(0, least(100, greatest(0, CASE WHEN closure_required = 1 THEN 35 ELSE 0 END
  + CASE corridor_tier WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 3 THEN 10 ELSE 0 END + {SEV}
  + CASE WHEN hour BETWEEN 7 AND 10 OR hour BETWEEN 16 AND 20 THEN 5 ELSE 0 END
  - CASE WHEN hour >= 22 OR hour <= 5 THEN 5 ELSE 0 END)) + 5 * ({CROWD_TIER}))) AS DOUBLE)"""
CLASS = """CASE WHEN {s} >= 75 THEN 'Critical' WHEN {s} >= 50 THEN 'High' WHEN {s} >= 25 THEN 'Medium' ELSE 'Low' END"""

FORECAST_SQL = f"""
ev AS (SELECT *, CAST(strptime(CAST(event_date AS VARCHAR) || ' ' || lpad(CAST(hour AS VARCHAR), 2, '0') || ':00', '%Y-%m-%d %H:%M') AS TIMESTAMP) AS event_datetime,
         {SCORE_SQL} AS predicted_impact_score FROM plan),
evc AS (SELECT *, {CLASS.format(s='predicted_impact_score')} AS predicted_risk_class FROM ev),
hp AS (SELECT corridor, hour, duration_minutes / 60 AS r, requires_road_closure AS c FROM inc WHERE event_type = 'planned'),
cc AS (SELECT corridor, count(*) AS n FROM hp GROUP BY corridor),
o AS (SELECT e.event_id, e.corridor, e.hour, CAST(x AS INT) AS hh FROM evc e, unnest(range(e.hour - 2, e.hour + 3)) t(x)),
wc AS (SELECT o.event_id, count(hp.hour) AS n, sum(hp.r) AS rs, count(hp.r) AS rn, sum(hp.c) AS cs
       FROM o LEFT JOIN hp ON o.corridor = hp.corridor AND o.hh = hp.hour GROUP BY o.event_id),
wa AS (SELECT o.event_id, count(hp.hour) AS n, sum(hp.r) AS rs, count(hp.r) AS rn, sum(hp.c) AS cs
       FROM o LEFT JOIN hp ON o.hh = hp.hour GROUP BY o.event_id),
ct AS (SELECT corridor, count(*) AS n, sum(r) AS rs, count(r) AS rn, sum(c) AS cs FROM hp GROUP BY corridor),
al AS (SELECT count(*) AS n, sum(r) AS rs, count(r) AS rn, sum(c) AS cs FROM hp),
sim AS (SELECT e.event_id,
  CASE WHEN e.corridor <> 'Non-corridor' AND coalesce(ct.n, 0) > 0 THEN (CASE WHEN wc.n > 0 THEN 1 ELSE 2 END)
       ELSE (CASE WHEN wa.n > 0 THEN 3 ELSE 4 END) END AS src,
  wc.n AS wcn, wc.rs AS wcrs, wc.rn AS wcrn, wc.cs AS wccs, ct.n AS ctn, ct.rs AS ctrs, ct.rn AS ctrn, ct.cs AS ctcs,
  wa.n AS wan, wa.rs AS wars, wa.rn AS warn, wa.cs AS wacs, al.n AS aln, al.rs AS alrs, al.rn AS alrn, al.cs AS alcs
  FROM evc e LEFT JOIN wc ON e.event_id = wc.event_id LEFT JOIN wa ON e.event_id = wa.event_id
  LEFT JOIN ct ON e.corridor = ct.corridor CROSS JOIN al),
simp AS (SELECT event_id,
  CAST(coalesce(CASE src WHEN 1 THEN wcn WHEN 2 THEN ctn WHEN 3 THEN wan ELSE aln END, 0) AS BIGINT) AS similar_count,
  CASE src WHEN 1 THEN wcrs WHEN 2 THEN ctrs WHEN 3 THEN wars ELSE alrs END AS rs,
  CASE src WHEN 1 THEN wcrn WHEN 2 THEN ctrn WHEN 3 THEN warn ELSE alrn END AS rn,
  CASE src WHEN 1 THEN wccs WHEN 2 THEN ctcs WHEN 3 THEN wacs ELSE alcs END AS cs FROM sim),
fc AS (SELECT evc.*, similar_count, CASE WHEN rn > 0 THEN rs / rn END AS avg_resolution_hours,
  CASE WHEN similar_count > 0 THEN cs * 100.0 / similar_count END AS closure_rate,
  CASE WHEN similar_count >= 10 THEN 'High' WHEN similar_count >= 5 THEN 'Medium' ELSE 'Low' END AS confidence_level
  FROM evc JOIN simp USING (event_id))"""


@query("crowd_features", f"""
WITH hc AS (SELECT corridor, count(*) AS n FROM inc GROUP BY corridor)
SELECT event_id, coalesce({sql_case_map('event_type', D.EVENT_TYPE_ENCODING)}, 4) AS event_type_encoded, corridor_tier,
  CASE WHEN corridor_tier > 0 THEN 1 ELSE 0 END AS is_corridor, hour, weekday, month,
  CASE WHEN weekday IN (5, 6) THEN 1 ELSE 0 END AS is_weekend, CASE WHEN hour >= 22 OR hour <= 5 THEN 1 ELSE 0 END AS is_night,
  expected_crowd, ln(1 + expected_crowd) AS crowd_log, {CROWD_TIER} AS crowd_tier,
  CASE WHEN closure_required = 1 THEN 1 ELSE 0 END AS closure_required,
  CAST(CASE WHEN coalesce(hc.n, 0) > 0 THEN hc.n ELSE 100 END AS BIGINT) AS corridor_event_count
FROM plan LEFT JOIN hc USING (corridor)""")
def q_crowd_features(spark, sf):
    """M11 / E03 / F10 / J09."""
    return FC.event_features(_events(spark, sf), _history(spark, sf))


@query("similar_planned_events", f"""
WITH {FORECAST_SQL}
SELECT event_id, similar_count, avg_resolution_hours, closure_rate, confidence_level FROM fc""")
def q_similar_planned_events(spark, sf):
    """Corridor → hour ± 2 ladder against the aggregated planned history."""
    return FC.similar_history(_events(spark, sf), _history(spark, sf))


@query("event_forecast", f"""
WITH {FORECAST_SQL}
SELECT event_id, predicted_impact_score, predicted_risk_class, confidence_level, similar_count, avg_resolution_hours,
  closure_rate FROM fc""")
def q_event_forecast(spark, sf):
    """M12 (score = rule baseline + crowd tier; the frozen model is absent)."""
    return _forecast(spark, sf).select("event_id", "predicted_impact_score", "predicted_risk_class", "confidence_level",
                                       "similar_count", "avg_resolution_hours", "closure_rate")


def _plan_actions_sql():
    rows = []
    for cls, acts in D.PLAN_ACTIONS.items():
        for i, a in enumerate(acts):
            rows.append(f"('{cls}', {i}, '{a}')")
    return "(VALUES " + ", ".join(rows) + ") AS pa(cls, i, action)"


@query("proactive_plan", f"""
WITH {FORECAST_SQL},
n AS (SELECT cls, count(*) AS k FROM {_plan_actions_sql()} GROUP BY cls),
a AS (SELECT f.event_id, f.predicted_risk_class IN ('High', 'Critical') AS pre_deployment_required, pa.i AS seq, pa.action
      FROM fc f JOIN {_plan_actions_sql()} ON f.predicted_risk_class = pa.cls),
b AS (SELECT f.event_id, f.predicted_risk_class IN ('High', 'Critical') AS pre_deployment_required, n.k AS seq,
        printf('Large crowd (%s) - Deploy crowd control barriers', format('{{:,}}', expected_crowd)) AS action
      FROM fc f JOIN n ON f.predicted_risk_class = n.cls WHERE expected_crowd > 50000),
c AS (SELECT f.event_id, f.predicted_risk_class IN ('High', 'Critical') AS pre_deployment_required,
        n.k + CASE WHEN expected_crowd > 50000 THEN 1 ELSE 0 END AS seq,
        'Road closure planned - Activate diversion routes in advance' AS action
      FROM fc f JOIN n ON f.predicted_risk_class = n.cls WHERE closure_required = 1)
SELECT event_id, pre_deployment_required, CAST(seq AS INT) AS seq, action FROM a
UNION ALL SELECT event_id, pre_deployment_required, CAST(seq AS INT), action FROM b
UNION ALL SELECT event_id, pre_deployment_required, CAST(seq AS INT), action FROM c""")
def q_proactive_plan(spark, sf):
    """Class template + crowd + closure actions, one row per action."""
    return FC.proactive_plan(_scored_events(spark, sf))


def _plan_timeline_sql():
    rows = [f"('{cls}', {i}, '{t}', '{a}', " + ", ".join(str(r[k]) if k in r else "NULL" for k in D.PLAN_RESOURCES) + ")"
            for cls, steps in D.PLAN_TIMELINE.items() for i, (t, a, r) in enumerate(steps)]
    return "(VALUES " + ", ".join(rows) + ") AS pt(cls, seq, time, action, " + ", ".join(D.PLAN_RESOURCES) + ")"


@query("proactive_timeline", f"""
WITH {FORECAST_SQL}
SELECT event_id, CAST(seq AS INT) AS seq, time, action, {", ".join(f"CAST({k} AS INT) AS {k}" for k in D.PLAN_RESOURCES)}
FROM evc JOIN {_plan_timeline_sql()} ON evc.predicted_risk_class = pt.cls""")
def q_proactive_timeline(spark, sf):
    """Deployment timeline with resources, one row per step."""
    return FC.proactive_timeline(_scored_events(spark, sf))


@query("event_briefing_events", f"""
WITH {FORECAST_SQL}
SELECT event_date, event_id, corridor, predicted_impact_score, predicted_risk_class, confidence_level, similar_count
FROM fc WHERE predicted_risk_class IN ('High', 'Critical')""")
def q_event_briefing_events(spark, sf):
    """The high-risk events of every daily briefing with their forecasts."""
    return FC.briefing_events(_forecast(spark, sf)).select(
        "event_date", "event_id", "corridor", "predicted_impact_score", "predicted_risk_class", "confidence_level", "similar_count")


@query("upcoming_events", f"""
WITH {FORECAST_SQL}
SELECT event_id, event_datetime, corridor, predicted_impact_score, predicted_risk_class FROM fc
WHERE event_datetime >= TIMESTAMP '{NOW} 00:00:00' AND event_datetime <= TIMESTAMP '{NOW} 00:00:00' + INTERVAL 7 DAY""")
def q_upcoming_events(spark, sf):
    """Next 7 days (inclusive) with forecasts, sorted by time."""
    f = FC.upcoming(_scored_events(spark, sf), NOW, 7)
    return f.select("event_id", "event_datetime", "corridor", "predicted_impact_score", "predicted_risk_class") \
            .orderBy("event_datetime", "event_id")


@query("event_briefing", f"""
WITH {FORECAST_SQL}
SELECT event_date, count(*) AS event_count, array_to_string(list_sort(list_distinct(list(corridor))), ', ') AS corridors_affected,
  CAST(sum(expected_crowd) AS BIGINT) AS total_expected_crowd, CAST(sum(closure_required) AS BIGINT) AS closures_planned,
  CAST(sum(CASE WHEN predicted_risk_class IN ('High', 'Critical') THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_count,
  CASE WHEN sum(CASE WHEN predicted_risk_class IN ('High', 'Critical') THEN 1 ELSE 0 END) > 0
    THEN printf('%d high-risk events require proactive deployment', sum(CASE WHEN predicted_risk_class IN ('High', 'Critical') THEN 1 ELSE 0 END))
    ELSE 'Standard monitoring recommended' END AS briefing_summary
FROM fc GROUP BY event_date""")
def q_event_briefing(spark, sf):
    """Daily briefing for every date at once."""
    return FC.event_briefing(_scored_events(spark, sf))


@query("high_risk_periods", f"""
WITH {FORECAST_SQL}
SELECT event_date, count(*) AS event_count, max(predicted_impact_score) AS max_risk_score
FROM fc WHERE event_datetime >= TIMESTAMP '{NOW} 00:00:00' AND event_datetime <= TIMESTAMP '{NOW} 00:00:00' + INTERVAL 30 DAY
  AND predicted_risk_class IN ('High', 'Critical')
GROUP BY event_date""")
def q_high_risk_periods(spark, sf):
    """M16."""
    return FC.high_risk_periods(_scored_events(spark, sf), NOW, 30).orderBy(F.desc("max_risk_score"), "event_date")


@query("high_risk_period_events", f"""
WITH {FORECAST_SQL}
SELECT event_date, event_id, corridor, predicted_impact_score, predicted_risk_class FROM fc
WHERE event_datetime >= TIMESTAMP '{NOW} 00:00:00' AND event_datetime <= TIMESTAMP '{NOW} 00:00:00' + INTERVAL 30 DAY
  AND predicted_risk_class IN ('High', 'Critical')""")
def q_high_risk_period_events(spark, sf):
    """The events of each high-risk period, long form."""
    return FC.high_risk_events(_scored_events(spark, sf), NOW, 30).select(
        "event_date", "event_id", "corridor", "predicted_impact_score", "predicted_risk_class")


CONFLICT_SQL = f"""
{FORECAST_SQL},
hs AS (SELECT DISTINCT event_date, hour FROM fc),
gap AS (SELECT event_date, max(CASE WHEN hour - prev <= 2 THEN 1 ELSE 0 END) AS near_distinct FROM
          (SELECT event_date, hour, lag(hour) OVER (PARTITION BY event_date ORDER BY hour) AS prev FROM hs) z GROUP BY event_date),
g AS (SELECT event_date, count(*) AS event_count, count(DISTINCT corridor) AS dc,
        sum(CASE WHEN predicted_risk_class IN ('High', 'Critical') THEN 1 ELSE 0 END) AS hr, sum(closure_required) AS cl,
        CAST(sum(expected_crowd) AS BIGINT) AS total_expected_crowd, count(DISTINCT hour) AS dh FROM fc GROUP BY event_date
      HAVING count(*) > 1),
r AS (SELECT g.*, coalesce(gap.near_distinct, 0) = 1 OR event_count > dh AS near FROM g LEFT JOIN gap USING (event_date)),
fired AS (
  SELECT event_date, 0 AS pos, 'Same Corridor Conflict' AS type, 3 AS points, 'Critical' AS severity FROM r WHERE event_count <> dc
  UNION ALL SELECT event_date, 1, 'Multiple High-Risk Events', 2, 'High' FROM r WHERE hr >= 2
  UNION ALL SELECT event_date, 2, 'Multiple Road Closures', 3, 'Critical' FROM r WHERE cl >= 2
  UNION ALL SELECT event_date, 3, 'Excessive Crowd Accumulation', 2, 'High' FROM r WHERE total_expected_crowd > 100000
  UNION ALL SELECT event_date, 4, 'Time Proximity Conflict', 1, 'Medium' FROM r WHERE near),
sc AS (SELECT r.event_date, r.event_count, r.total_expected_crowd, CAST(coalesce(sum(points), 0) AS INT) AS conflict_severity_score
       FROM r LEFT JOIN fired USING (event_date) GROUP BY r.event_date, r.event_count, r.total_expected_crowd)"""


@query("event_conflicts", f"""
WITH {CONFLICT_SQL}
SELECT event_date, event_count, total_expected_crowd, conflict_severity_score,
  CASE WHEN conflict_severity_score >= 6 THEN 'Critical' WHEN conflict_severity_score >= 3 THEN 'High'
       WHEN conflict_severity_score >= 1 THEN 'Medium' ELSE 'Low' END AS overall_severity FROM sc""")
def q_event_conflicts(spark, sf):
    """Conflict report for every date with more than one event."""
    c = FC.event_conflicts(_scored_events(spark, sf))
    return c.select("event_date", "event_count", "total_expected_crowd", "conflict_severity_score", "overall_severity")


@query("event_conflict_neighbours", """
WITH p AS (SELECT a.event_id, count(*) AS n_same, count(CASE WHEN abs(a.hour - b.hour) <= 2 THEN 1 END) AS n_near,
    min(CASE WHEN abs(a.hour - b.hour) <= 2 THEN struct_pack(gap := abs(a.hour - b.hour), id := b.event_id) END) AS m
  FROM plan a JOIN plan b ON a.event_date = b.event_date AND a.corridor = b.corridor AND a.event_id <> b.event_id GROUP BY a.event_id)
SELECT e.event_id, e.event_date, e.corridor, e.hour, coalesce(n_same, 0) AS n_same, coalesce(n_near, 0) AS n_near,
  p.m.id AS nearest_id, CAST(p.m.gap AS INT) AS gap_hours FROM plan e LEFT JOIN p ON p.event_id = e.event_id""")
def q_event_conflict_neighbours(spark, sf):
    """For every event the others of its date and corridor, those within 2 hours, and the nearest."""
    return FC.event_neighbours(X.plan(spark, sf).select("event_id", "event_date", "corridor", "hour"))


@query("event_conflict_rules", f"""
WITH {CONFLICT_SQL}
SELECT event_date, CAST(pos AS INT) AS pos, type, points, severity,
  CASE pos WHEN 0 THEN 'Multiple events on the same corridor will cause severe congestion'
    WHEN 1 THEN printf('%d high-risk events on same day will strain resources', hr)
    WHEN 2 THEN printf('%d road closures will significantly disrupt city traffic', cl)
    WHEN 3 THEN printf('Total %s people expected across events', format('{{:,}}', total_expected_crowd))
    ELSE 'Events occurring within 2 hours of each other' END AS description,
  CASE pos WHEN 0 THEN 'Reschedule one event or prepare extensive diversion routes'
    WHEN 1 THEN printf('Pre-position %d additional officers and %d barricades', hr * 15, hr * 25)
    WHEN 2 THEN 'Coordinate closure timings to avoid overlap if possible'
    WHEN 3 THEN 'Deploy crowd control units and setup emergency medical facilities'
    ELSE 'Ensure rapid resource redeployment between events' END AS recommendation
FROM fired JOIN r USING (event_date)""")
def q_event_conflict_rules(spark, sf):
    """Fired rules as rows."""
    c = FC.event_conflicts(_scored_events(spark, sf))
    return c.select("event_date", F.explode("rules").alias("r")).select("event_date", "r.*")
