"""Descriptive aggregate queries (A01–A19, A26–A33, O03, O07) over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eda as A
from ..operators.profiles import NON_CORRIDOR, with_class
from ..sources import fixtures as X
from .registry import query

CLASS_SQL = """CASE WHEN impact_score >= 75 THEN 'Critical' WHEN impact_score >= 50 THEN 'High'
       WHEN impact_score >= 25 THEN 'Medium' ELSE 'Low' END"""


def res(spark, sf):
    """Scored incidents with resolution hours (NULL where the duration is missing)."""
    return X.scored(spark, sf).withColumn("resolution_time_hours", F.col("duration_minutes") / 60)


@query("city_kpis", f"""
SELECT count(*) AS total_events, CAST(sum(CASE WHEN {CLASS_SQL} = 'Critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical_count,
  CAST(sum(requires_road_closure) AS BIGINT) AS closure_count, round(avg(impact_score), 6) AS avg_impact,
  count(DISTINCT corridor) AS unique_corridors, count(DISTINCT police_station) AS unique_stations
FROM scored""")
def q_city_kpis(spark, sf):
    """A01 / A26 KPI block."""
    return A.city_kpis(X.scored(spark, sf))


@query("class_distribution", f"SELECT {CLASS_SQL} AS impact_class, count(*) AS n FROM scored GROUP BY 1")
def q_class_distribution(spark, sf):
    """A02."""
    return A.class_distribution(X.scored(spark, sf))


@query("closure_rate_by_cause", """
WITH t AS (SELECT event_cause FROM inc GROUP BY event_cause ORDER BY count(*) DESC, event_cause LIMIT 12)
SELECT event_cause, round(avg(requires_road_closure) * 100, 6) AS closure_rate
FROM inc WHERE event_cause IN (SELECT event_cause FROM t) GROUP BY event_cause""")
def q_closure_rate_by_cause(spark, sf):
    """A03 + J14 (semi join to the top-12 causes), O02 sort."""
    return A.closure_rate_by_cause(X.inc(spark, sf)).orderBy(F.desc("closure_rate"), "event_cause")


@query("corridor_hour_heatmap", """
WITH t AS (SELECT corridor FROM inc WHERE corridor <> 'Non-corridor' GROUP BY corridor
           ORDER BY count(*) DESC, corridor LIMIT 10)
SELECT corridor, hour, count(*) AS n FROM inc
WHERE corridor <> 'Non-corridor' AND corridor IN (SELECT corridor FROM t) GROUP BY corridor, hour""")
def q_corridor_hour_heatmap(spark, sf):
    """A04 + J14."""
    return A.corridor_hour_heatmap(X.inc(spark, sf))


@query("corridor_hour_pivot", """
WITH t AS (SELECT corridor FROM inc GROUP BY corridor ORDER BY count(*) DESC, corridor LIMIT 10)
SELECT corridor, """ + ", ".join(f"count(*) FILTER (WHERE hour = {h}) AS h{h:02d}" for h in range(24)) + """
FROM inc WHERE corridor IN (SELECT corridor FROM t) GROUP BY corridor""")
def q_corridor_hour_pivot(spark, sf):
    """Pivot with 0 fill."""
    return A.corridor_hour_pivot(X.inc(spark, sf))


@query("risk_heatmap", """
WITH c AS (SELECT corridor, avg(impact_score) AS ca FROM scored GROUP BY corridor),
h AS (SELECT corridor, hour, avg(impact_score) AS ha FROM scored GROUP BY corridor, hour),
g AS (SELECT corridor, ca, CAST(r AS INT) AS hour FROM c CROSS JOIN range(24) t(r))
SELECT g.corridor, g.hour, round(coalesce(h.ha, g.ca, 0), 6) AS risk
FROM g LEFT JOIN h ON g.corridor = h.corridor AND g.hour = h.hour""")
def q_risk_heatmap(spark, sf):
    """A06 + J15: corridor × hour grid with corridor-mean fallback."""
    return A.risk_heatmap(X.scored(spark, sf))


@query("resolution_stats", """
SELECT round(median(duration_minutes / 60), 6) AS median, round(avg(duration_minutes / 60), 6) AS mean,
  round(quantile_cont(duration_minutes / 60, 0.9), 6) AS p90, round(max(duration_minutes / 60), 6) AS max
FROM inc""")
def q_resolution_stats(spark, sf):
    """Exact median / mean / p90 / max."""
    return A.resolution_stats(res(spark, sf))


@query("corridor_resolution", """
SELECT corridor, round(median(duration_minutes / 60), 6) AS median, count(duration_minutes) AS n
FROM inc GROUP BY corridor HAVING count(duration_minutes) >= 50 ORDER BY median DESC, corridor LIMIT 15""")
def q_corridor_resolution(spark, sf):
    """Group median, HAVING count ≥ 50, top 15."""
    return A.group_median(res(spark, sf), "corridor", "resolution_time_hours", 50, 15).select("corridor", "median", "n")


@query("resolution_by_cause", """
WITH t AS (SELECT event_cause FROM inc GROUP BY event_cause ORDER BY count(*) DESC, event_cause LIMIT 10)
SELECT event_cause, count(duration_minutes) AS n, round(min(duration_minutes / 60), 6) AS min,
  round(quantile_cont(duration_minutes / 60, 0.25), 6) AS q1, round(quantile_cont(duration_minutes / 60, 0.5), 6) AS median,
  round(quantile_cont(duration_minutes / 60, 0.75), 6) AS q3, round(max(duration_minutes / 60), 6) AS max
FROM inc WHERE event_cause IN (SELECT event_cause FROM t) GROUP BY event_cause""")
def q_resolution_by_cause(spark, sf):
    """Box-plot statistics for the top-10 causes."""
    return A.box_stats(res(spark, sf), "event_cause", "resolution_time_hours", 10)


@query("resolution_histogram", """
WITH x AS (SELECT duration_minutes / 60 AS v FROM inc WHERE duration_minutes IS NOT NULL),
m AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 50)), 49) END AS INT) AS bin, lo, hi
      FROM x CROSS JOIN m)
SELECT bin, round(lo + bin * (hi - lo) / 50, 6) AS bin_lo, round(lo + (bin + 1) * (hi - lo) / 50, 6) AS bin_hi,
  count(*) AS n FROM b GROUP BY bin, lo, hi""")
def q_resolution_histogram(spark, sf):
    """A10: 50 equal-width bins (left-closed, last closed)."""
    from ..operators.stats import histogram
    return histogram(res(spark, sf), "resolution_time_hours", 50)


_CORR_COLS = ["hour", "weekday", "longitude", "is_weekend", "is_night", "resolution_time_hours", "requires_road_closure",
              "latitude"]


def _corr_base_sql():
    return """(SELECT hour, weekday, longitude, CASE WHEN weekday >= 5 THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN hour >= 22 OR hour <= 5 THEN 1 ELSE 0 END AS is_night, duration_minutes / 60 AS resolution_time_hours,
       requires_road_closure, latitude FROM inc) x"""


@query("correlation_matrix", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM "
    + _corr_base_sql() for a in _CORR_COLS for b in _CORR_COLS) + ") u")
def q_correlation_matrix(spark, sf):
    """Pairwise-complete Pearson matrix in one aggregate, long form."""
    d = res(spark, sf)
    from ..functions.temporal import is_night, is_weekend
    d = d.withColumn("is_weekend", is_weekend(F.col("weekday"))).withColumn("is_night", is_night(F.col("hour")))
    return A.correlation_matrix(d, _CORR_COLS)


@query("missing_values", """
WITH n AS (SELECT count(*) AS total FROM inc),
u AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count FROM inc"
    for c in ["id", "start_datetime", "event_cause", "event_type", "corridor", "corridor_tier", "police_station",
              "junction", "veh_type", "requires_road_closure", "hour", "weekday", "month", "duration_minutes", "latitude",
              "longitude", "k"]) + """)
SELECT column_name, missing_count, round(missing_count * 100.0 / total, 6) AS missing_pct
FROM u CROSS JOIN n WHERE missing_count > 0 ORDER BY missing_count DESC, column_name LIMIT 10""")
def q_missing_values(spark, sf):
    """NULL counts per column from one aggregate, unpivoted."""
    return A.missing_values(X.inc(spark, sf))


@query("dataset_summary", """
SELECT count(*) AS total_incidents, CAST(min(start_datetime) AS DATE) AS first_day, CAST(max(start_datetime) AS DATE) AS last_day,
  CAST(floor((epoch_us(max(start_datetime)) - epoch_us(min(start_datetime))) / 86400000000.0) AS BIGINT) AS duration_days,
  count(DISTINCT corridor) AS unique_corridors, count(DISTINCT police_station) AS unique_stations,
  count(DISTINCT event_cause) AS event_causes, count(DISTINCT veh_type) AS vehicle_types,
  CAST(sum(CASE WHEN event_type = 'planned' THEN 1 ELSE 0 END) AS BIGINT) AS planned_events,
  CAST(sum(CASE WHEN event_type = 'unplanned' THEN 1 ELSE 0 END) AS BIGINT) AS unplanned_events,
  CAST(sum(requires_road_closure) AS BIGINT) AS road_closures,
  round(median(duration_minutes / 60), 6) AS median_resolution_hours,
  min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon
FROM inc""")
def q_dataset_summary(spark, sf):
    """A13 + A33."""
    return A.dataset_summary(res(spark, sf))


@query("daily_trend", """
WITH d AS (SELECT CAST(start_datetime AS DATE) AS day, count(*) AS n FROM inc GROUP BY 1),
p AS (SELECT day AS pday FROM d ORDER BY n DESC, day LIMIT 1)
SELECT day, n, round(avg(n) OVER (), 6) AS mean_per_day, CAST(day = pday AS INT) AS is_peak_day FROM d CROSS JOIN p""")
def q_daily_trend(spark, sf):
    """A14 / O05."""
    return A.daily_trend(X.inc(spark, sf))


@query("hourly_distribution", """
WITH h AS (SELECT hour, count(*) AS n FROM inc WHERE hour IS NOT NULL GROUP BY hour),
p AS (SELECT hour AS ph FROM h ORDER BY n DESC, hour LIMIT 1)
SELECT hour, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct,
  CASE WHEN hour BETWEEN 7 AND 10 THEN 'morning' WHEN hour BETWEEN 16 AND 20 THEN 'evening' ELSE 'other' END AS rush_window,
  CAST(hour = ph AS INT) AS is_peak_hour FROM h CROSS JOIN p""")
def q_hourly_distribution(spark, sf):
    """A15."""
    return A.hourly_distribution(X.inc(spark, sf))


@query("weekday_distribution", """
WITH w AS (SELECT weekday, count(*) AS n FROM inc WHERE weekday IS NOT NULL GROUP BY weekday),
b AS (SELECT weekday AS bw FROM w ORDER BY n DESC, weekday LIMIT 1),
q AS (SELECT weekday AS qw FROM w ORDER BY n ASC, weekday LIMIT 1)
SELECT weekday, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][weekday + 1] AS weekday_name, n,
  CAST(weekday = bw AS INT) AS is_busiest, CAST(weekday = qw AS INT) AS is_quietest,
  round(sum(CASE WHEN weekday >= 5 THEN n ELSE 0 END) OVER () * 100.0 / sum(n) OVER (), 6) AS weekend_pct
FROM w CROSS JOIN b CROSS JOIN q""")
def q_weekday_distribution(spark, sf):
    """A16."""
    return A.weekday_distribution(X.inc(spark, sf))


@query("top_share", """
WITH r AS (SELECT police_station, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, police_station) AS rnk
           FROM inc WHERE police_station IS NOT NULL GROUP BY police_station)
SELECT police_station, n, CAST(rnk AS INT) AS rnk,
  CAST(sum(CASE WHEN rnk <= 3 THEN n ELSE 0 END) OVER () AS BIGINT) AS top_total,
  round(sum(CASE WHEN rnk <= 3 THEN n ELSE 0 END) OVER () * 100.0 / sum(n) OVER (), 6) AS top_pct
FROM r QUALIFY rnk <= 15""")
def q_top_share(spark, sf):
    """Top-15 stations and the share of the top 3."""
    return A.top_share(X.inc(spark, sf), "police_station", 15, 3)


@query("cause_distribution_others", """
WITH r AS (SELECT event_cause, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_cause) AS rnk
           FROM inc GROUP BY event_cause)
SELECT CASE WHEN rnk <= 3 THEN event_cause ELSE 'Others' END AS event_cause, CAST(sum(n) AS BIGINT) AS n
FROM r GROUP BY 1""")
def q_cause_distribution_others(spark, sf):
    """Top-k + Others (k = 3 here: the view has five causes; the reference uses 8)."""
    return A.top_k_with_others(X.inc(spark, sf), "event_cause", 3)


def _cond_sql(flag_expr: str, name: str) -> str:
    return f"""SELECT {flag_expr} AS {name}, count(*) AS n, round(avg(requires_road_closure) * 100, 6) AS closure_rate,
  round(median(duration_minutes / 60), 6) AS median_resolution, round(avg(duration_minutes / 60), 6) AS mean_resolution
FROM inc GROUP BY 1"""


@query("planned_vs_unplanned", _cond_sql("event_type", "event_type"))
def q_planned_vs_unplanned(spark, sf):
    """Planned vs unplanned profile."""
    return A.conditional_profile(res(spark, sf), "event_type")


@query("closure_comparison", _cond_sql("requires_road_closure", "requires_road_closure"))
def q_closure_comparison(spark, sf):
    """Closure vs no closure."""
    return A.conditional_profile(res(spark, sf), "requires_road_closure")


@query("transit_share", """
SELECT CAST(sum(CASE WHEN veh_type IN ('bmtc_bus', 'ksrtc_bus') THEN 1 ELSE 0 END) AS BIGINT) AS transit_incidents,
  round(sum(CASE WHEN veh_type IN ('bmtc_bus', 'ksrtc_bus') THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS transit_pct
FROM inc""")
def q_transit_share(spark, sf):
    """Public-transit share."""
    d = X.inc(spark, sf)
    t = F.when(F.col("veh_type").isin("bmtc_bus", "ksrtc_bus"), 1).otherwise(0)
    return d.agg(F.sum(t).cast("long").alias("transit_incidents"), (F.sum(t) * 100.0 / F.count(F.lit(1))).alias("transit_pct"))


@query("fleet_demand", """
SELECT corridor, round(sum(CASE WHEN event_cause = 'vehicle_breakdown' THEN 1 ELSE 0 END) / 150.0, 6) AS tow_trucks_per_day,
  round(count(*) / 150.0 * 1.5, 6) AS officers_per_day, round(count(*) / 150.0, 6) AS daily_incidents
FROM inc WHERE corridor <> 'Non-corridor' GROUP BY corridor ORDER BY daily_incidents DESC, corridor LIMIT 15""")
def q_fleet_demand(spark, sf):
    """A28."""
    return A.fleet_demand(X.inc(spark, sf))


@query("density_grid", """
WITH m AS (SELECT min(latitude) la0, max(latitude) la1, min(longitude) lo0, max(longitude) lo1 FROM scored
           WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
c AS (SELECT CAST(CASE WHEN lo1 = lo0 THEN 0 ELSE least(floor((longitude - lo0) / (lo1 - lo0) * 30), 29) END AS INT) AS cell_x,
             CAST(CASE WHEN la1 = la0 THEN 0 ELSE least(floor((latitude - la0) / (la1 - la0) * 30), 29) END AS INT) AS cell_y,
             impact_score FROM scored CROSS JOIN m WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
SELECT cell_x, cell_y, count(*) AS n, round(avg(impact_score / 100), 6) AS weight FROM c GROUP BY cell_x, cell_y""")
def q_density_grid(spark, sf):
    """A30."""
    return A.density_grid(X.scored(spark, sf))


@query("hexagon_grid", """
WITH d AS (SELECT * FROM scored WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
m AS (SELECT min(latitude) la0, max(latitude) la1, min(longitude) lo0, max(longitude) lo1 FROM d),
p AS (SELECT impact_score, m.*, CASE WHEN lo1 = lo0 THEN 0 ELSE (longitude - lo0) / (lo1 - lo0) * 30 END AS x,
        CASE WHEN la1 = la0 THEN 0 ELSE (latitude - la0) / (la1 - la0) * 17 END AS y FROM d CROSS JOIN m),
c AS (SELECT *, round_even(x, 0) AS x1, round_even(y, 0) AS y1, floor(x) AS x2, floor(y) AS y2 FROM p),
h AS (SELECT *, (x - x1) * (x - x1) + 3 * (y - y1) * (y - y1) < (x - x2 - 0.5) * (x - x2 - 0.5) + 3 * (y - y2 - 0.5) * (y - y2 - 0.5) AS one FROM c),
k AS (SELECT *, CAST(CASE WHEN one THEN 2 * x1 ELSE 2 * x2 + 1 END AS INT) AS col, CAST(CASE WHEN one THEN 2 * y1 ELSE 2 * y2 + 1 END AS INT) AS r FROM h)
SELECT CAST((col - r) / 2 AS INT) AS q, r, any_value(lo0) + (any_value(lo1) - any_value(lo0)) / 30 * col / 2 AS center_lon,
  any_value(la0) + (any_value(la1) - any_value(la0)) / 17 * r / 2 AS center_lat, count(*) AS n, avg(impact_score / 100) AS weight
FROM k GROUP BY col, r""")
def q_hexagon_grid(spark, sf):
    """Hexagonal density at gridsize 30."""
    return A.hexagon_grid(X.scored(spark, sf))


@query("corridor_centroid", """
SELECT corridor, round(avg(latitude), 6) AS center_lat, round(avg(longitude), 6) AS center_lon, count(*) AS n
FROM inc WHERE corridor <> 'Non-corridor' GROUP BY corridor""")
def q_corridor_centroid(spark, sf):
    """Corridor centroid of incidents."""
    d = X.inc(spark, sf).filter(F.col("corridor") != NON_CORRIDOR)
    return d.groupBy("corridor").agg(F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lon"),
                                     F.count(F.lit(1)).alias("n"))


@query("slot_intensity", """
WITH g AS (SELECT CAST(w AS INT) AS weekday, CAST(h AS INT) AS hour FROM range(7) a(w) CROSS JOIN range(24) b(h)),
c AS (SELECT weekday, hour, count(*) AS n FROM inc GROUP BY weekday, hour),
s AS (SELECT g.weekday, g.hour, coalesce(c.n, 0) AS event_count FROM g LEFT JOIN c USING (weekday, hour)),
x AS (SELECT *, event_count / greatest(max(event_count) OVER (), 1) AS intensity FROM s)
SELECT weekday, hour, event_count, round(intensity, 6) AS intensity,
  CASE WHEN intensity > 0.7 THEN 4 WHEN intensity > 0.5 THEN 3 WHEN intensity > 0.3 THEN 2 WHEN intensity > 0.1 THEN 1 ELSE 0 END AS level
FROM x""")
def q_slot_intensity(spark, sf):
    """168-slot intensity levels."""
    from ..operators.profiles import risk_window
    return A.slot_intensity(risk_window(X.scored(spark, sf)))


@query("slot_forecast", """
WITH w AS (SELECT greatest(1, CAST(ceil((date_diff('day', min(CAST(start_datetime AS DATE)), max(CAST(start_datetime AS DATE))) + 1) / 7.0) AS BIGINT)) AS weeks FROM scored),
g AS (SELECT corridor, weekday, hour, count(*) AS n, avg(requires_road_closure) * 100 AS cp, max(impact_score) AS mx
      FROM scored GROUP BY corridor, weekday, hour),
t AS (SELECT corridor, weekday, hour, event_cause AS top_cause FROM
        (SELECT corridor, weekday, hour, event_cause,
                row_number() OVER (PARTITION BY corridor, weekday, hour ORDER BY count(*) DESC, event_cause) AS r
         FROM scored GROUP BY corridor, weekday, hour, event_cause) z WHERE r = 1)
SELECT g.corridor, g.weekday, g.hour, round(n / weeks, 6) AS expected_events, round(cp, 6) AS closure_probability,
  round(mx, 6) AS max_observed_score, top_cause
FROM g CROSS JOIN w LEFT JOIN t ON g.corridor = t.corridor AND g.weekday = t.weekday AND g.hour = t.hour""")
def q_slot_forecast(spark, sf):
    """A32."""
    return A.slot_forecast(X.scored(spark, sf))


@query("incident_feed", f"""
SELECT id, start_datetime, event_cause, corridor, {CLASS_SQL} AS status, hour, coalesce(veh_type, 'others') AS veh_type,
  requires_road_closure AS closure
FROM scored ORDER BY start_datetime DESC, id DESC LIMIT 25""")
def q_incident_feed(spark, sf):
    """O07 / D13 (real event times): latest 25 incidents."""
    d = with_class(X.scored(spark, sf), out="status")
    d = d.select("id", "start_datetime", "event_cause", "corridor", "status", "hour",
                 F.coalesce("veh_type", F.lit("others")).alias("veh_type"), F.col("requires_road_closure").alias("closure"))
    return A.latest(d)
