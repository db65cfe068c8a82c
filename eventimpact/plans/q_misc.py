"""Diversion, closure barricades and water-logging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diversion as DV
from ..operators import weather as WE
from ..sources import dims as D
from ..sources import fixtures as X
from .q_basic import _NAME_SQL
from .registry import query


def hav(a, b, c, d):
    x = f"(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))"
    return f"(6371.0 * 2 * atan2(sqrt({x}), sqrt(1 - {x})))"


CREQ_SQL = f"""creq AS (SELECT event_id AS request_id, {_NAME_SQL} AS corridor,
  12.5 + ((user_id * 37) % 1000) / CAST(1000 AS DOUBLE) AS start_lat, 77.0 + ((user_id * 91) % 1000) / CAST(1000 AS DOUBLE) AS start_lon,
  12.5 + ((user_id * 37) % 1000) / CAST(1000 AS DOUBLE) + 0.01 AS end_lat, 77.0 + ((user_id * 91) % 1000) / CAST(1000 AS DOUBLE) + 0.01 AS end_lon
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e WHERE k < 8)"""

_ROUTES = [(c, i + 1, n, a[0], a[1], b[0], b[1]) for c, (_, _, roads) in D.CORRIDOR_ROUTES.items()
           for i, (n, a, b) in enumerate(roads)]
RD_SQL = "rd AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {i}, '{n}', {a}, {b}, {cc}, {d})" for c, i, n, a, b, cc, d in _ROUTES) + \
    ") AS t(rc, route_no, route_name, a_lat, a_lon, b_lat, b_lon))"
SPEC_SQL = f"""sp AS (SELECT r.request_id, r.corridor, rd.route_no, rd.route_name, {hav('a_lat', 'a_lon', 'b_lat', 'b_lon')} AS route_km
  FROM creq r JOIN rd ON r.corridor = rd.rc AND rd.route_no <= 3)"""
GEN_SQL = f"""gn AS (SELECT r.request_id, r.corridor, CAST(i + 1 AS INT) AS route_no, printf('Alternate Route %d', i + 1) AS route_name,
    {hav('start_lat', 'start_lon', 'end_lat', 'end_lon')} * (1.2 + i * 0.1) AS route_km, CAST(5 + i * 3 AS INT) AS time_diff_min,
    (start_lat + end_lat) / 2 AS mid_lat, (start_lon + end_lon) / 2 AS mid_lon
  FROM creq r CROSS JOIN range(3) t(i) WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.rc = r.corridor))"""


def _requests(spark, sf):
    return X.closure_requests(spark, sf)


@query("diversion_routes", f"""
WITH {CREQ_SQL}, {RD_SQL}, {SPEC_SQL}
SELECT request_id, corridor, route_no, route_name, route_km, CAST(trunc(route_km / 30 * 60) AS INT) AS time_diff_min,
  'alternate_' || CAST(route_no AS VARCHAR) AS route_type FROM sp""")
def q_diversion_routes(spark, sf):
    """M18 / N05 / F04 / F05 / J12 (left-join branch): parallel routes of mapped corridors."""
    return DV.specific_routes(_requests(spark, sf))


@query("diversion_generic", f"""
WITH {CREQ_SQL}, {RD_SQL}, {GEN_SQL}
SELECT request_id, corridor, route_no, route_name, route_km, time_diff_min, mid_lat, mid_lon FROM gn""")
def q_diversion_generic(spark, sf):
    """M18b / J12 (anti-join branch): generic routes for every other corridor (NULL and misspelt included)."""
    return DV.generic_routes(_requests(spark, sf))


@query("diversion_plan", f"""
WITH {CREQ_SQL}, {RD_SQL}, {SPEC_SQL}, {GEN_SQL},
s AS (SELECT request_id, count(*) AS n, avg(CAST(trunc(route_km / 30 * 60) AS INT)) AS d,
        arg_min(route_name, route_no) AS rec FROM sp GROUP BY request_id),
g AS (SELECT request_id, count(*) AS n, avg(time_diff_min) AS d FROM gn GROUP BY request_id)
SELECT r.request_id, CASE WHEN s.n IS NOT NULL THEN r.corridor ELSE 'Generic' END AS plan_corridor,
  {hav('start_lat', 'start_lon', 'end_lat', 'end_lon')} AS length_km, coalesce(s.n, g.n) AS n_routes,
  coalesce(s.d, g.d) AS estimated_avg_delay_min, CASE WHEN s.n IS NOT NULL THEN pi() * 2.0 * 2.0 ELSE 4.0 END AS affected_area_km2,
  coalesce(s.rec, 'Alternate Route 1') AS recommended_route
FROM creq r LEFT JOIN s ON r.request_id = s.request_id LEFT JOIN g ON r.request_id = g.request_id""")
def q_diversion_plan(spark, sf):
    """Plan summary per closure request."""
    return DV.diversion_plan(_requests(spark, sf))


@query("closure_barricades", f"""
WITH {CREQ_SQL}
SELECT request_id, 0 AS pos, 'Closure Entry Point' AS location, start_lat AS latitude, start_lon AS longitude, 'full_closure' AS type, 4 AS count FROM creq
UNION ALL SELECT request_id, 1, 'Closure Exit Point', end_lat, end_lon, 'full_closure', 4 FROM creq
UNION ALL SELECT request_id, 2, 'Diversion Junction', (start_lat + end_lat) / 2 + 0.005, (start_lon + end_lon) / 2 + 0.005, 'diversion', 3 FROM creq
UNION ALL SELECT request_id, 3, 'Pedestrian Safety Zone', (start_lat + end_lat) / 2 - 0.005, (start_lon + end_lon) / 2, 'pedestrian_safety', 2 FROM creq""")
def q_closure_barricades(spark, sf):
    """M19."""
    return DV.closure_barricades(_requests(spark, sf))


WX_NOW = "2024-01-29 00:00:00"


@query("water_logging_risk", f"""
WITH cor AS (SELECT DISTINCT corridor FROM inc),
cen AS (SELECT DISTINCT corridor FROM inc WHERE corridor <> 'Non-corridor'),
it AS (SELECT corridor, CAST(day AS TIMESTAMP) + to_hours(slot * 3) AS its, rain_3h_mm, rain_prob FROM wx),
f AS (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY its) AS r FROM it WHERE its >= TIMESTAMP '{WX_NOW}'),
a AS (SELECT corridor, sum(rain_3h_mm) AS tr, avg(rain_prob) AS ap, count(*) AS n FROM f WHERE r <= 8 GROUP BY corridor),
j AS (SELECT cor.corridor, cen.corridor IS NOT NULL AS known, a.n IS NOT NULL AS has, tr, ap,
        round(tr + 1e-9 * sign(tr), 1) AS r1,
        CASE WHEN tr > 50 THEN 'Critical' WHEN tr > 25 THEN 'High' WHEN tr > 10 THEN 'Medium' ELSE 'Low' END AS risk
      FROM cor LEFT JOIN cen ON cor.corridor = cen.corridor LEFT JOIN a ON cor.corridor = a.corridor)
SELECT corridor, CASE WHEN NOT known OR NOT has THEN 'Unknown' ELSE risk END AS risk_level,
  CASE WHEN NOT known THEN 'Corridor not found' WHEN NOT has THEN 'Weather data unavailable' END AS reason,
  CASE WHEN known AND has THEN r1 END AS total_rain_mm,
  CASE WHEN known AND has THEN
    CASE risk WHEN 'Critical' THEN printf('URGENT: Deploy water pumps and barricades. Expected %.1fmm rain - severe water logging likely.', r1)
      WHEN 'High' THEN printf('Deploy preventive measures. %.1fmm rain forecast - moderate water logging risk.', r1)
      WHEN 'Medium' THEN printf('Monitor closely. %.1fmm rain expected - minor pooling possible.', r1)
      ELSE 'Normal operations. Low rain forecast.' END END AS recommendation,
  CASE WHEN known AND has THEN CASE WHEN ap > 0.7 THEN 'High' WHEN ap > 0.4 THEN 'Medium' ELSE 'Low' END END AS confidence
FROM j""")
def q_water_logging_risk(spark, sf):
    """24 h ahead (8 items) from the 3 h rain view; centroids from incidents."""
    inc = X.inc(spark, sf)
    corridors = inc.select("corridor").distinct()
    cen = inc.filter(F.col("corridor") != "Non-corridor").select("corridor").distinct()
    items = X.wx(spark, sf).withColumn(
        "its", F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + F.col("slot") * 10800))
    return WE.water_logging_risk(corridors, cen, items, "its", WX_NOW, forecast_hours=24)
