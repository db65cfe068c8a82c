"""Profile queries (A20–A25) over the ``scored`` fixture view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as P
from ..sources import fixtures as X
from .registry import query


@query("stress_index", """
WITH g AS (
  SELECT corridor, count(*) AS frequency, avg(impact_score) AS avg_impact,
         avg(requires_road_closure) AS cr
  FROM scored WHERE corridor <> 'Non-corridor' GROUP BY corridor),
m AS (SELECT max(frequency) AS mf, max(avg_impact) AS mi, max(cr) AS mc FROM g)
SELECT corridor,
  round((0.4 * CASE WHEN mf > 0 THEN frequency / mf ELSE 0 END
       + 0.4 * CASE WHEN mi > 0 THEN avg_impact / mi ELSE 0 END
       + 0.2 * CASE WHEN mc > 0 THEN cr / mc ELSE 0 END) * 100, 6) AS stress_index,
  frequency, round(avg_impact, 6) AS avg_impact, round(cr * 100, 6) AS closure_rate
FROM g CROSS JOIN m
""")
def q_stress_index(spark, sf):
    """Corridor stress index (max-normalised, Non-corridor excluded), sorted desc."""
    return P.stress_index(X.scored(spark, sf)).orderBy(F.desc("stress_index"), "corridor")


CLASS = """CASE WHEN impact_score >= 75 THEN 'Critical' WHEN impact_score >= 50 THEN 'High'
       WHEN impact_score >= 25 THEN 'Medium' ELSE 'Low' END"""


def _mode_sql(src: str, group: str, key: str, out: str) -> str:
    return f"""(SELECT {group}, {key} AS {out} FROM (SELECT {group}, {key},
      row_number() OVER (PARTITION BY {group} ORDER BY count(*) DESC, {key}) AS r
      FROM {src} WHERE {key} IS NOT NULL GROUP BY {group}, {key}) z WHERE r = 1)"""


_STRESS_SQL = """(SELECT corridor, (0.4 * CASE WHEN mf > 0 THEN f / mf ELSE 0 END + 0.4 * CASE WHEN ma > 0 THEN a / ma ELSE 0 END
   + 0.2 * CASE WHEN mc > 0 THEN c / mc ELSE 0 END) * 100 AS stress_index
 FROM (SELECT corridor, count(*) AS f, avg(impact_score) AS a, avg(requires_road_closure) AS c FROM scored
       WHERE corridor <> 'Non-corridor' GROUP BY corridor) g
 CROSS JOIN (SELECT max(f) mf, max(a) ma, max(c) mc FROM (SELECT count(*) AS f, avg(impact_score) AS a,
       avg(requires_road_closure) AS c FROM scored WHERE corridor <> 'Non-corridor' GROUP BY corridor) q) m)"""


@query("corridor_profile", f"""
WITH d AS (SELECT *, {CLASS} AS impact_class FROM scored WHERE corridor <> 'Non-corridor'),
b AS (SELECT corridor, count(*) AS total_incidents, avg(requires_road_closure) * 100 AS closure_rate,
        CAST(sum(CASE WHEN impact_class = 'Critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical_count,
        avg(impact_score) AS avg_impact, max(corridor_tier) AS t FROM d GROUP BY corridor)
SELECT b.corridor, CAST(coalesce(t, 3) AS INT) AS tier, total_incidents, closure_rate,
  critical_count * 100.0 / total_incidents AS critical_rate, critical_count,
  coalesce(mc.dominant_cause, 'unknown') AS dominant_cause, coalesce(mh.peak_hour, 10) AS peak_hour,
  coalesce(ms.station, 'Unknown') AS station, avg_impact, coalesce(st.stress_index, 0) AS stress_index
FROM b LEFT JOIN {_mode_sql('d', 'corridor', 'event_cause', 'dominant_cause')} mc ON b.corridor = mc.corridor
LEFT JOIN {_mode_sql('d', 'corridor', 'hour', 'peak_hour')} mh ON b.corridor = mh.corridor
LEFT JOIN {_mode_sql('d', 'corridor', 'police_station', 'station')} ms ON b.corridor = ms.corridor
LEFT JOIN {_STRESS_SQL} st ON b.corridor = st.corridor""")
def q_corridor_profile(spark, sf):
    """A20 / W05 (flagship): corridor DNA with three ranked modes and the stress index."""
    return P.corridor_profile(X.scored(spark, sf))


RISK_WINDOW_SQL = f"""
g AS (SELECT CAST(w AS INT) AS weekday, CAST(h AS INT) AS hour FROM range(7) a(w) CROSS JOIN range(24) b(h)),
a AS (SELECT weekday, hour, count(*) AS n, sum(CASE WHEN {CLASS} = 'Critical' THEN 1 ELSE 0 END) AS cc,
        avg(impact_score) AS ai FROM scored GROUP BY weekday, hour),
rw AS (SELECT g.weekday, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][g.weekday + 1] AS weekday_name,
        g.hour, coalesce(n, 0) AS event_count,
        CASE WHEN coalesce(n, 0) > 0 THEN cc * 100.0 / n ELSE 0 END AS critical_rate,
        CAST(coalesce(cc, 0) AS BIGINT) AS critical_count, coalesce(ai, 0) AS avg_impact
      FROM g LEFT JOIN a ON g.weekday = a.weekday AND g.hour = a.hour)"""


@query("risk_window", f"WITH {RISK_WINDOW_SQL} SELECT * FROM rw")
def q_risk_window(spark, sf):
    """All 168 weekday × hour slots."""
    return P.risk_window(X.scored(spark, sf))


@query("risk_window_slot", f"WITH {RISK_WINDOW_SQL} SELECT * FROM rw WHERE weekday = 4")
def q_risk_window_slot(spark, sf):
    """Optional slot filter (weekday = Friday, every hour)."""
    return P.slot_filter(P.risk_window(X.scored(spark, sf)), weekday=4)


TOPK_SQL = """
tc AS (SELECT weekday, hour, 'corridor' AS kind, corridor AS name, count(*) AS count,
         row_number() OVER (PARTITION BY weekday, hour ORDER BY count(*) DESC, corridor) AS rnk
       FROM scored WHERE corridor <> 'Non-corridor' GROUP BY weekday, hour, corridor),
tu AS (SELECT weekday, hour, 'cause' AS kind, event_cause AS name, count(*) AS count,
         row_number() OVER (PARTITION BY weekday, hour ORDER BY count(*) DESC, event_cause) AS rnk
       FROM scored GROUP BY weekday, hour, event_cause),
topk AS (SELECT * FROM tc WHERE rnk <= 3 UNION ALL SELECT * FROM tu WHERE rnk <= 3)"""


@query("risk_window_top_causes", f"""
WITH {TOPK_SQL} SELECT weekday, hour, kind, name, count, CAST(rnk AS INT) AS rnk FROM topk""")
def q_risk_window_top(spark, sf):
    """A23 + N01 / W06 (flattened): top-3 corridors (Non-corridor excluded) and causes per slot."""
    d = X.scored(spark, sf)
    c = P.ranked_counts(d.filter(F.col("corridor") != P.NON_CORRIDOR), ["weekday", "hour"], "corridor", 3)
    u = P.ranked_counts(d, ["weekday", "hour"], "event_cause", 3)
    return (c.select("weekday", "hour", F.lit("corridor").alias("kind"), F.col("corridor").alias("name"), "count", "rnk")
            .unionByName(u.select("weekday", "hour", F.lit("cause").alias("kind"), F.col("event_cause").alias("name"),
                                  "count", "rnk")))


@query("station_profile", f"""
WITH d AS (SELECT *, {CLASS} AS impact_class FROM scored WHERE police_station IS NOT NULL AND trim(police_station) <> '')
SELECT police_station AS station, count(*) AS event_count,
  CAST(sum(CASE WHEN impact_class = 'Critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical_count,
  sum(CASE WHEN impact_class = 'Critical' THEN 1 ELSE 0 END) * 100.0 / count(*) AS critical_rate,
  avg(impact_score) AS avg_impact, avg(requires_road_closure) * 100 AS closure_rate
FROM d GROUP BY police_station""")
def q_station_profile(spark, sf):
    """Station intelligence (NULL/blank stations dropped)."""
    return P.station_profile(X.scored(spark, sf))


@query("station_top_lists", """
WITH d AS (SELECT * FROM scored WHERE police_station IS NOT NULL AND trim(police_station) <> ''),
a AS (SELECT police_station AS station, 'cause' AS kind, event_cause AS name, count(*) AS count,
        row_number() OVER (PARTITION BY police_station ORDER BY count(*) DESC, event_cause) AS rnk
      FROM d GROUP BY police_station, event_cause),
b AS (SELECT police_station AS station, 'corridor' AS kind, corridor AS name, count(*) AS count,
        row_number() OVER (PARTITION BY police_station ORDER BY count(*) DESC, corridor) AS rnk
      FROM d WHERE corridor <> 'Non-corridor' GROUP BY police_station, corridor)
SELECT station, kind, name, count, CAST(rnk AS INT) AS rnk FROM a WHERE rnk <= 3
UNION ALL SELECT station, kind, name, count, CAST(rnk AS INT) AS rnk FROM b WHERE rnk <= 3""")
def q_station_top_lists(spark, sf):
    """A24 + N01: top-3 causes and corridors per station (flattened)."""
    d = X.scored(spark, sf).filter(F.col("police_station").isNotNull() & (F.trim("police_station") != ""))
    d = d.withColumnRenamed("police_station", "station")
    a = P.ranked_counts(d, ["station"], "event_cause", 3)
    b = P.ranked_counts(d.filter(F.col("corridor") != P.NON_CORRIDOR), ["station"], "corridor", 3)
    return (a.select("station", F.lit("cause").alias("kind"), F.col("event_cause").alias("name"), "count", "rnk")
            .unionByName(b.select("station", F.lit("corridor").alias("kind"), F.col("corridor").alias("name"),
                                  "count", "rnk")))


SHIFT_SQL = f"""
{RISK_WINDOW_SQL},
rs AS (SELECT *, round(avg_impact + 1e-9 * sign(avg_impact), 1) AS ai1,
         CASE WHEN hour >= 6 AND hour < 14 THEN 'Morning' WHEN hour >= 14 AND hour < 22 THEN 'Evening' ELSE 'Night' END AS shift
       FROM rw),
sh AS (SELECT shift, sum(event_count) AS total_events, sum(critical_count) AS tc,
         sum(CASE WHEN event_count > 0 THEN ai1 * event_count ELSE 0 END) AS wsum FROM rs GROUP BY shift),
shr AS (SELECT shift, CAST(total_events AS BIGINT) AS total_events,
          CASE WHEN total_events > 0 THEN round(tc * 100.0 / total_events + 1e-9, 1) ELSE 0 END AS critical_rate,
          CASE WHEN total_events > 0 THEN round(wsum / total_events + 1e-9, 1) ELSE 0 END AS avg_impact FROM sh)"""


@query("shift_briefing", f"""
WITH {SHIFT_SQL}
SELECT shift AS shift_name, CASE shift WHEN 'Morning' THEN '06:00 - 14:00' WHEN 'Evening' THEN '14:00 - 22:00'
  ELSE '22:00 - 06:00' END AS shift_hours,
  CASE WHEN avg_impact >= 40 OR critical_rate >= 10 THEN 'High' WHEN avg_impact >= 25 OR critical_rate >= 5 THEN 'Elevated'
       ELSE 'Normal' END AS stress_level, total_events, critical_rate, avg_impact FROM shr""")
def q_shift_briefing(spark, sf):
    """All three shifts, rolled up from the 168-slot window with slot means rounded first."""
    from ..operators.shifts import shift_briefing
    return shift_briefing(X.scored(spark, sf))


@query("shift_briefing_top", f"""
WITH {TOPK_SQL},
s AS (SELECT CASE WHEN hour >= 6 AND hour < 14 THEN 'Morning' WHEN hour >= 14 AND hour < 22 THEN 'Evening' ELSE 'Night' END AS shift,
        kind, name, count FROM topk),
t AS (SELECT shift, kind, name, sum(count) AS total FROM s GROUP BY shift, kind, name),
r AS (SELECT *, row_number() OVER (PARTITION BY shift, kind ORDER BY total DESC, name) AS rnk FROM t)
SELECT shift AS shift_name, kind, name, CAST(total AS BIGINT) AS count, CAST(rnk AS INT) AS rnk FROM r WHERE rnk <= 5""")
def q_shift_briefing_top(spark, sf):
    """A25 + N03 / T13: top-5 corridors and causes per shift, summed from the slots' top-3 lists."""
    from ..operators.shifts import shift_top_lists
    return shift_top_lists(X.scored(spark, sf))
