"""Evidence, scoring, resources and placement queries.

Requests are the incidents of ``inc`` (every incident asks "how bad, what to send"); the history is ``scored``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import risk_class, round_half
from ..operators import evidence as EV
from ..operators import profiles as P
from ..operators import scoring as SC
from ..sources import dims as D
from ..sources import fixtures as X
from .oracle import sql_case_map, sql_values
from .registry import query

CLASS = """CASE WHEN {s} >= 75 THEN 'Critical' WHEN {s} >= 50 THEN 'High' WHEN {s} >= 25 THEN 'Medium' ELSE 'Low' END"""

REQ_SQL = """req AS (SELECT id AS request_id, event_cause AS cause, corridor, corridor_tier AS tier,
  requires_road_closure AS closure, veh_type AS vehicle_type, hour, weekday, latitude, longitude FROM inc)"""

EVIDENCE_SQL = f"""
agg AS (SELECT event_cause, corridor_tier, requires_road_closure,
          grouping(event_cause, corridor_tier, requires_road_closure) AS gid, count(*) AS n, avg(impact_score) AS avg_score,
          CAST(sum(CASE WHEN cls = 'Critical' THEN 1 ELSE 0 END) AS BIGINT) AS n_critical,
          CAST(sum(CASE WHEN cls = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS n_high,
          CAST(sum(CASE WHEN cls = 'Medium' THEN 1 ELSE 0 END) AS BIGINT) AS n_medium,
          CAST(sum(CASE WHEN cls = 'Low' THEN 1 ELSE 0 END) AS BIGINT) AS n_low
        FROM (SELECT *, {CLASS.format(s='impact_score')} AS cls FROM scored) h
        GROUP BY GROUPING SETS ((event_cause, corridor_tier, requires_road_closure), (event_cause, corridor_tier), (event_cause))),
g1 AS (SELECT * FROM agg WHERE gid = 0), g2 AS (SELECT * FROM agg WHERE gid = 1), g3 AS (SELECT * FROM agg WHERE gid = 3),
ev AS (SELECT r.*, CASE WHEN coalesce(g1.n, 0) >= 5 THEN 1 WHEN coalesce(g2.n, 0) >= 3 THEN 2 ELSE 3 END AS rung,
         coalesce(g1.n, 0) AS matching_count,
         g1.n AS n_1, g2.n AS n_2, g3.n AS n_3, g1.avg_score AS a_1, g2.avg_score AS a_2, g3.avg_score AS a_3,
         g1.n_critical AS c_1, g2.n_critical AS c_2, g3.n_critical AS c_3, g1.n_high AS h_1, g2.n_high AS h_2, g3.n_high AS h_3,
         g1.n_medium AS m_1, g2.n_medium AS m_2, g3.n_medium AS m_3, g1.n_low AS l_1, g2.n_low AS l_2, g3.n_low AS l_3
       FROM req r
       LEFT JOIN g1 ON r.cause = g1.event_cause AND r.tier = g1.corridor_tier AND r.closure = g1.requires_road_closure
       LEFT JOIN g2 ON r.cause = g2.event_cause AND r.tier = g2.corridor_tier
       LEFT JOIN g3 ON r.cause = g3.event_cause),
evd AS (SELECT *, CAST(coalesce(CASE rung WHEN 1 THEN n_1 WHEN 2 THEN n_2 ELSE n_3 END, 0) AS BIGINT) AS evidence_count,
          CASE rung WHEN 1 THEN a_1 WHEN 2 THEN a_2 ELSE a_3 END AS a_pick,
          coalesce(CASE rung WHEN 1 THEN c_1 WHEN 2 THEN c_2 ELSE c_3 END, 0) AS c_pick,
          coalesce(CASE rung WHEN 1 THEN h_1 WHEN 2 THEN h_2 ELSE h_3 END, 0) AS n_high,
          coalesce(CASE rung WHEN 1 THEN m_1 WHEN 2 THEN m_2 ELSE m_3 END, 0) AS n_medium,
          coalesce(CASE rung WHEN 1 THEN l_1 WHEN 2 THEN l_2 ELSE l_3 END, 0) AS n_low FROM ev),
evf AS (SELECT *, CASE WHEN evidence_count > 0 THEN c_pick * 100.0 / evidence_count ELSE 0 END AS critical_rate,
          CASE WHEN evidence_count > 0 THEN a_pick ELSE 0 END AS average_score, c_pick AS n_critical FROM evd)"""

SEV_SQL = f"coalesce({sql_case_map('cause', D.CAUSE_SEVERITY)}, 5)"
BASELINE_SQL = f"""least(100, greatest(0, CASE WHEN closure = 1 THEN 35 ELSE 0 END
  + CASE tier WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 3 THEN 10 ELSE 0 END + {SEV_SQL}
  + CASE WHEN hour BETWEEN 7 AND 10 OR hour BETWEEN 16 AND 20 THEN 5 ELSE 0 END
  - CASE WHEN hour >= 22 OR hour <= 5 THEN 5 ELSE 0 END))"""
BLEND_SQL = f"""least(100.0, greatest(0.0, CAST(
  CASE WHEN evidence_count > 10 THEN bs * 0.4 + round(average_score + 1e-9 * sign(average_score), 1) * 0.6
       WHEN evidence_count > 5 THEN bs * 0.5 + round(average_score + 1e-9 * sign(average_score), 1) * 0.5 ELSE bs END
  + CASE WHEN closure = 1 THEN 15 ELSE 0 END + CASE WHEN tier = 1 THEN 10 WHEN tier = 2 THEN 5 ELSE 0 END
  + CASE WHEN cause IN ('protest', 'water_logging') THEN 10 WHEN cause = 'tree_fall' THEN 5 ELSE 0 END
  - CASE WHEN hour >= 22 OR hour <= 5 THEN 8 ELSE 0 END AS DOUBLE)))"""


def requests(spark, sf):
    return X.inc(spark, sf).select(
        F.col("id").alias("request_id"), F.col("event_cause").alias("cause"), "corridor",
        F.col("corridor_tier").alias("tier"), F.col("requires_road_closure").alias("closure"),
        F.col("veh_type").alias("vehicle_type"), "hour", "weekday", "latitude", "longitude")


def scored_requests(spark, sf):
    """Requests with evidence, M03 baseline as the model score, M04 blend and class."""
    req = requests(spark, sf)
    ev = EV.evidence_lookup(req, X.scored(spark, sf))
    base, comps = SC.operational_baseline(F.col("cause"), F.col("tier"), F.col("closure"), F.col("hour"))
    ev = ev.withColumn("baseline_score", base.cast("double")).withColumn("components", comps)
    final = SC.blend_score(F.col("baseline_score"), F.col("evidence_count"), F.col("average_score"), F.col("closure"),
                           F.col("tier"), F.col("cause"), F.col("hour"))
    return ev.withColumn("final_score", final).withColumn("risk_class", risk_class(F.col("final_score")))


@query("evidence_grouping_sets", f"""
WITH {EVIDENCE_SQL.split('g1 AS')[0].rstrip().rstrip(',')}
SELECT CASE gid WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS grain, event_cause, corridor_tier, requires_road_closure,
  n, round(avg_score, 6) AS avg_score, n_critical, n_high, n_medium, n_low FROM agg""")
def q_evidence_grouping_sets(spark, sf):
    """One GROUPING SETS aggregate over the three evidence grains."""
    return EV.evidence_aggregate(X.scored(spark, sf)).select(
        "grain", "event_cause", "corridor_tier", "requires_road_closure", "n", "avg_score", "n_critical", "n_high",
        "n_medium", "n_low")


_LADDER_REQ_SQL = """req AS (SELECT c.cause, CAST(t.tier AS INT) AS tier, CAST(k.closure AS INT) AS closure FROM
  (SELECT DISTINCT event_cause AS cause FROM inc UNION SELECT DISTINCT event_type AS cause FROM plan) c
  CROSS JOIN range(5) t(tier) CROSS JOIN range(2) k(closure))"""


def _ladder_requests(spark, sf):
    causes = (X.inc(spark, sf).select(F.col("event_cause").alias("cause"))
              .union(X.plan(spark, sf).select(F.col("event_type").alias("cause"))).distinct())
    return (causes.select("cause", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("tier"))
            .select("cause", "tier", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("closure")))


@query("evidence_lookup", f"""
WITH {_LADDER_REQ_SQL}, {EVIDENCE_SQL}
SELECT cause, tier, closure, rung, evidence_count, round(critical_rate, 6) AS critical_rate,
  round(average_score, 6) AS average_score, n_low, n_medium, n_high, n_critical, matching_count FROM evf""")
def q_evidence_lookup(spark, sf):
    """Fallback ladder for every (cause × tier 0–4 × closure) request; causes come from the
    incidents and the calendar (calendar types have no history → zeros); tier 4 never exists → rung 3."""
    out = EV.evidence_lookup(_ladder_requests(spark, sf), X.scored(spark, sf))
    return out.select("cause", "tier", "closure", "rung", "evidence_count", "critical_rate", "average_score", "n_low",
                      "n_medium", "n_high", "n_critical", "matching_count")


@query("confidence_level", f"""
WITH {REQ_SQL}, {EVIDENCE_SQL}
SELECT request_id, matching_count,
  CASE WHEN matching_count >= 30 THEN 'High' WHEN matching_count >= 10 THEN 'Medium' ELSE 'Low' END AS level FROM evf""")
def q_confidence_level(spark, sf):
    """J04 / M05."""
    ev = EV.evidence_lookup(requests(spark, sf), X.scored(spark, sf))
    return ev.select("request_id", "matching_count", EV.confidence_level().alias("level"))


@query("operational_baseline", f"""
WITH {REQ_SQL}
SELECT request_id, CAST({BASELINE_SQL} AS INT) AS baseline_score,
  concat_ws('; ', CASE WHEN closure = 1 THEN 'Road Closure:+35' END,
    CASE WHEN tier IN (1, 2, 3) THEN printf('Tier %d Corridor:+%d', tier, CASE tier WHEN 1 THEN 30 WHEN 2 THEN 20 ELSE 10 END) END,
    printf('Cause Severity (%s):+%d', cause, {SEV_SQL}),
    CASE WHEN hour BETWEEN 7 AND 10 OR hour BETWEEN 16 AND 20 THEN 'Rush Hour:+5' END,
    CASE WHEN hour >= 22 OR hour <= 5 THEN 'Night Hours:-5' END) AS components
FROM req""")
def q_operational_baseline(spark, sf):
    """M03."""
    r = requests(spark, sf)
    base, comps = SC.operational_baseline(F.col("cause"), F.col("tier"), F.col("closure"), F.col("hour"))
    return r.select("request_id", base.cast("int").alias("baseline_score"), comps.alias("components"))


@query("score_blend", f"""
WITH {REQ_SQL}, {EVIDENCE_SQL},
s AS (SELECT *, CAST({BASELINE_SQL} AS DOUBLE) AS bs FROM evf),
b AS (SELECT *, {BLEND_SQL} AS final_score FROM s)
SELECT request_id, evidence_count, round(final_score, 6) AS final_score,
  {CLASS.format(s='final_score')} AS risk_class FROM b""")
def q_score_blend(spark, sf):
    """M04 (model score = M03 baseline, override table empty)."""
    return scored_requests(spark, sf).select("request_id", "evidence_count", "final_score", "risk_class")


RES_SQL = """
res AS (SELECT b.*, coalesce(t.police, o.police) AS t_police, coalesce(t.barricades, o.barricades) AS t_barricades,
          coalesce(t.crew, o.crew) AS t_crew, coalesce(t.tow, o.tow) AS t_tow, coalesce(t.diversion, o.diversion) AS t_div,
          coalesce(t.rmed, o.rmed) AS t_rmed, coalesce(t.rrange, o.rrange) AS t_rrange,
          coalesce({rm}, 1.0) * coalesce({tm}, 1.0) AS mult
        FROM {src} b LEFT JOIN {tpl} ON b.cause = t.tcause
        CROSS JOIN (SELECT * FROM {tpl2} WHERE o.tcause = 'others') o)"""


def _res_sql(src: str, risk: str) -> str:
    rows = [(k, *v) for k, v in SC.RESOURCE_TEMPLATES.items()]
    cols = ["tcause", "police", "barricades", "crew", "tow", "diversion", "rmed", "rrange"]
    return RES_SQL.format(rm=sql_case_map(risk, D.RISK_MULTIPLIER), tm=sql_case_map("tier", D.TIER_MULTIPLIER),
                          src=src, tpl=sql_values(rows, cols), tpl2=sql_values(rows, cols).replace("AS t(", "AS o("))


RES_SELECT = f"""greatest(0, CAST(round_even(t_police * mult, 0) AS INT)) AS police_units,
  greatest(0, CAST(round_even(t_tow * mult, 0) AS INT)) AS tow_trucks,
  greatest(0, CAST(round_even(t_barricades * mult, 0) AS INT)) AS barricades, t_crew AS special_team,
  (t_div OR (risk_class IN ('Critical', 'High') AND tier >= 1)) AS diversion_required,
  coalesce({sql_case_map(f"coalesce({sql_case_map('vehicle_type', D.VEH_DISPLAY_MAP)}, vehicle_type)", D.VEH_NOTES)}, '') AS vehicle_note,
  t_rmed AS resolution_median, t_rrange AS resolution_range,
  risk_class || ' (' || coalesce({sql_case_map("risk_class", {k: f"{v}x" for k, v in D.RISK_MULTIPLIER.items()})}, '1.0x') || ')' AS risk_multiplier,
  CASE WHEN tier > 0 THEN 'Tier ' || CAST(tier AS VARCHAR) || ' (' || coalesce({sql_case_map("tier", {k: f"{v}x" for k, v in D.TIER_MULTIPLIER.items()})}, '1.0x') || ')'
    ELSE 'Non-corridor (1.0x)' END AS tier_multiplier, {sql_case_map("risk_class || '|' || CAST(tier AS VARCHAR)", SC.MULTIPLIER_TEXT)} AS total_multiplier"""


def _risk_requests(spark, sf):
    """Requests with the class of their incident's v2 label."""
    return X.scored(spark, sf).select(
        F.col("id").alias("request_id"), F.col("event_cause").alias("cause"), "corridor", F.col("corridor_tier").alias("tier"),
        F.col("requires_road_closure").alias("closure"), F.col("veh_type").alias("vehicle_type"), "hour", "weekday",
        "latitude", "longitude", risk_class(F.col("impact_score")).alias("risk_class"))


RISK_REQ_SQL = f"""rq AS (SELECT r.*, {CLASS.format(s='s.impact_score')} AS risk_class FROM req r JOIN scored s ON r.request_id = s.id)"""


@query("resource_scaling", f"""
WITH {REQ_SQL}, {RISK_REQ_SQL}, {_res_sql('rq', 'risk_class')}
SELECT request_id, cause, risk_class, tier, vehicle_type, {RES_SELECT} FROM res""")
def q_resource_scaling(spark, sf):
    """M09 / J03 / F03."""
    r = _risk_requests(spark, sf).select("request_id", "cause", "risk_class", "tier", "vehicle_type")
    return SC.resource_scaling(r)


@query("barricade_placement", f"""
WITH {REQ_SQL}, {RISK_REQ_SQL}, {_res_sql('rq', 'risk_class')},
n AS (SELECT request_id, cause, risk_class, tier, latitude, longitude,
        greatest(0, CAST(round_even(t_barricades * mult, 0) AS INT)) AS total FROM res),
p AS (SELECT *, greatest(2, CAST(round_even(total * 0.4, 0) AS INT)) AS p1 FROM n WHERE total > 0),
q AS (SELECT *, total - p1 AS rem1,
        CASE WHEN tier >= 1 AND total - p1 >= 2 THEN greatest(2, CAST(round_even((total - p1) * 0.5, 0) AS INT)) END AS p2 FROM p),
r AS (SELECT *, rem1 - coalesce(p2, 0) AS rem2, cause IN ('tree_fall', 'water_logging', 'protest') AS ped FROM q),
u AS (
  SELECT request_id, total, tier, risk_class, 1 AS priority, 'Incident Site - Entry Block' AS location_type, latitude,
    longitude, p1 AS count,
    CASE WHEN risk_class IN ('Critical', 'High') THEN 'full_closure' ELSE 'partial_closure' END AS type,
    'Block vehicle entry to incident site' AS reason, 'T-0 (immediate)' AS deployment_time, CAST(NULL AS INT) AS metres FROM r
  UNION ALL
  SELECT request_id, total, tier, risk_class, 2, 'Upstream Junction - Diversion', latitude + 0.0045, longitude, p2,
    'diversion_signage', 'Redirect traffic to alternate route 500m before incident', 'T-0 to T+5min', 500 FROM r WHERE p2 IS NOT NULL
  UNION ALL
  SELECT request_id, total, tier, risk_class, 3, CASE WHEN ped THEN 'Pedestrian Safety Zone' ELSE 'Downstream Exit Block' END,
    CASE WHEN ped THEN latitude ELSE latitude - 0.0027 END, CASE WHEN ped THEN longitude + 0.0018 ELSE longitude END, rem2,
    CASE WHEN ped THEN 'pedestrian_safety' ELSE 'exit_control' END,
    CASE WHEN ped THEN 'Protect pedestrian movement near incident' ELSE 'Prevent vehicles from exiting blocked segment' END,
    'T+5min to T+10min', CASE WHEN ped THEN 200 ELSE 300 END FROM r WHERE rem2 >= 2
  UNION ALL
  SELECT request_id, total, tier, risk_class, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM n WHERE total = 0)
SELECT request_id, priority, location_type, latitude, longitude, CAST(count AS INT) AS count, type, reason, deployment_time,
  metres AS distance_from_incident_m, CASE WHEN total > 0 THEN true END AS gps_verified, total * 2 AS setup_time_min,
  CASE WHEN total = 0 THEN 'No barricades required'
       WHEN risk_class = 'Critical' THEN 'Immediate full closure with police escort for barricade deployment'
       WHEN risk_class = 'High' THEN 'Phased deployment: Site blocking first, then diversion points'
       ELSE 'Standard deployment: Sequential placement based on priority' END AS deployment_strategy,
  CASE WHEN total > 0 THEN CASE WHEN tier >= 1 THEN 800 ELSE 300 END END AS total_coverage_area_m FROM u""")
def q_barricade_placement(spark, sf):
    """Placements as rows, at each incident's coordinates."""
    r = SC.resource_scaling(_risk_requests(spark, sf))
    out = SC.barricade_placement(r.select("request_id", "cause", "risk_class", "tier", "latitude", "longitude",
                                          "barricades"), lat="latitude", lon="longitude")
    return out.select("request_id", "priority", "location_type", "latitude", "longitude", "count", "type", "reason", "deployment_time",
                      "distance_from_incident_m", "gps_verified", "setup_time_min", "deployment_strategy", "total_coverage_area_m")


_TIMELINE_ROWS = [(k, i, ph, ", ".join(a)) for k, v in D.RESOURCE_TEMPLATES.items() for i, (ph, a) in enumerate(v["timeline"])]


@query("resource_timeline", f"""
WITH {REQ_SQL}, tl AS (SELECT * FROM {sql_values(_TIMELINE_ROWS, ["tcause", "seq", "phase", "actions"])}),
k AS (SELECT request_id, CASE WHEN cause IN (SELECT tcause FROM tl) THEN cause ELSE 'others' END AS tcause FROM req)
SELECT request_id, CAST(seq AS INT) AS seq, phase, actions FROM k JOIN tl USING (tcause)""")
def q_resource_timeline(spark, sf):
    """Response timeline of every request."""
    return SC.resource_timeline(requests(spark, sf).select("request_id", "cause")).select("request_id", "seq", "phase", "actions")


@query("evidence_examples", f"""
WITH {_LADDER_REQ_SQL}, {EVIDENCE_SQL},
hx AS (SELECT id, event_cause, corridor_tier, requires_road_closure, corridor, hour, impact_score, md5(CAST(id AS VARCHAR)) AS h FROM scored),
m AS (SELECT r.cause, r.tier, r.closure, r.rung, hx.*, row_number() OVER (PARTITION BY r.cause, r.tier, r.closure ORDER BY h) AS pos
      FROM evf r JOIN hx ON r.cause = hx.event_cause AND (r.rung = 3 OR r.tier = hx.corridor_tier)
        AND (r.rung > 1 OR r.closure = hx.requires_road_closure))
SELECT cause, tier, closure, rung, CAST(pos AS INT) AS pos, id AS example_id, corridor, hour, impact_score,
  {CLASS.format(s='impact_score')} AS impact_class, requires_road_closure AS example_closure FROM m WHERE pos <= 5""")
def q_evidence_examples(spark, sf):
    """Up to five examples for every (cause × tier × closure) request, on the rung its evidence uses."""
    history = X.scored(spark, sf)
    ev = EV.evidence_lookup(_ladder_requests(spark, sf), history).select("cause", "tier", "closure", "rung")
    out = EV.evidence_examples(ev, history)
    return out.select("cause", "tier", "closure", "rung", "pos", "example_id", "corridor", "hour", "impact_score",
                      risk_class(F.col("impact_score")).alias("impact_class"), "example_closure")


@query("transit_chain", f"""
WITH {REQ_SQL},
h AS (SELECT count(*) AS hc FROM inc WHERE event_cause = 'vehicle_breakdown'
        AND replace(lower(coalesce(veh_type, '')), ' ', '_') IN ('bmtc_bus', 'ksrtc_bus') AND corridor_tier = 1),
t AS (SELECT *, cause = 'vehicle_breakdown' AND replace(lower(coalesce(vehicle_type, '')), ' ', '_') IN ('bmtc_bus', 'ksrtc_bus')
        AND tier = 1 AS triggered FROM req CROSS JOIN h)
SELECT request_id, triggered, CASE WHEN triggered THEN hc END AS historical_cases,
  CASE WHEN triggered THEN hc * 60 END AS estimated_passenger_disruption,
  CASE WHEN triggered THEN CASE WHEN contains(replace(lower(coalesce(vehicle_type, '')), ' ', '_'), 'bmtc') THEN 'BMTC' ELSE 'KSRTC' END END AS bus_type
FROM t""")
def q_transit_chain(spark, sf):
    """A29."""
    out = EV.transit_chain(requests(spark, sf), X.inc(spark, sf))
    return out.select("request_id", "triggered", "historical_cases", "estimated_passenger_disruption", "bus_type")


_STRESS_CTE = """
sg AS (SELECT corridor, count(*) AS f, avg(impact_score) AS a, avg(requires_road_closure) AS c
       FROM scored WHERE corridor <> 'Non-corridor' GROUP BY corridor),
sm AS (SELECT max(f) mf, max(a) ma, max(c) mc FROM sg),
st AS (SELECT corridor, (0.4 * CASE WHEN mf > 0 THEN f / mf ELSE 0 END + 0.4 * CASE WHEN ma > 0 THEN a / ma ELSE 0 END
         + 0.2 * CASE WHEN mc > 0 THEN c / mc ELSE 0 END) * 100 AS stress_index FROM sg CROSS JOIN sm)"""


@query("prediction_breakdown", f"""
WITH {REQ_SQL}, {_STRESS_CTE},
b AS (SELECT r.request_id, r.cause, r.closure, r.hour, r.weekday,
        CASE WHEN st.corridor IS NULL THEN 0 ELSE r.tier END AS tier,
        round(st.stress_index + 1e-9 * sign(st.stress_index), 1) AS s1 FROM req r LEFT JOIN st ON r.corridor = st.corridor),
c AS (SELECT *, CASE WHEN hour IN (7, 8, 9, 17, 18, 19) THEN 1 ELSE 0 END AS pk,
        CASE WHEN hour >= 22 OR hour <= 5 THEN 1 ELSE 0 END AS nt,
        coalesce({sql_case_map('cause', D.BREAKDOWN_CAUSE_POINTS)}, 20) AS cp,
        CASE WHEN s1 IS NULL THEN 10 ELSE CAST(floor(s1 / 5) AS INT) END AS sp FROM b),
u AS (
  SELECT request_id, 0 AS pos, 'Road Closure' AS feature, CASE WHEN closure = 1 THEN 'Yes' ELSE 'No' END AS value,
    CASE WHEN closure = 1 THEN 45 ELSE 10 END AS contribution, CASE WHEN closure = 1 THEN 'High' ELSE 'Low' END AS impact FROM c
  UNION ALL SELECT request_id, 1, 'Corridor Tier', printf('Tier %d', tier), coalesce(CASE tier WHEN 0 THEN 15 WHEN 1 THEN 35 WHEN 2 THEN 28 WHEN 3 THEN 20 END, 20),
    CASE WHEN tier = 1 THEN 'Critical' WHEN tier = 2 THEN 'High' ELSE 'Medium' END FROM c
  UNION ALL SELECT request_id, 2, 'Incident Cause',
    array_to_string(list_transform(string_split(replace(cause, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '),
    cp, CASE WHEN cp > 30 THEN 'Critical' WHEN cp > 20 THEN 'High' ELSE 'Medium' END FROM c
  UNION ALL SELECT request_id, 3, 'Time of Day',
    printf('%d:00 (%s)', hour, CASE WHEN pk = 1 THEN 'Peak Hour' WHEN nt = 1 THEN 'Night' ELSE 'Regular Hours' END),
    CASE WHEN pk = 1 THEN 25 WHEN nt = 1 THEN 8 ELSE 15 END, CASE WHEN pk = 1 THEN 'High' WHEN nt = 1 THEN 'Low' ELSE 'Medium' END FROM c
  UNION ALL SELECT request_id, 4, 'Day of Week', ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][weekday + 1],
    CASE WHEN weekday >= 5 THEN 10 ELSE 18 END, CASE WHEN weekday >= 5 THEN 'Low' ELSE 'Medium' END FROM c
  UNION ALL SELECT request_id, 5, 'Corridor Stress Index', CASE WHEN s1 IS NULL THEN 'Unknown' ELSE CAST(s1 AS VARCHAR) END,
    sp, CASE WHEN sp > 15 THEN 'High' ELSE 'Medium' END FROM c)
SELECT request_id, pos, feature, value, contribution, impact,
  sum(contribution) OVER (PARTITION BY request_id) AS total_estimated_score FROM u""")
def q_prediction_breakdown(spark, sf):
    """Additive contributions in long form (``pos`` keeps the reference's item order)."""
    r = requests(spark, sf)
    st = P.stress_index(X.scored(spark, sf)).select("corridor", "stress_index")
    r = r.join(st, "corridor", "left").withColumn(
        "tier", F.when(F.col("stress_index").isNull(), 0).otherwise(F.col("tier")))
    out = SC.prediction_breakdown(r.select("request_id", "cause", "tier", "closure", "hour", "weekday", "stress_index"))
    return out.select("request_id", "pos", "feature", "value", "contribution", "impact", "total_estimated_score")


@query("impact_narrative", f"""
WITH {REQ_SQL}, {EVIDENCE_SQL},
s AS (SELECT *, CAST({BASELINE_SQL} AS DOUBLE) AS bs FROM evf),
b AS (SELECT *, {BLEND_SQL} AS final_score, round(average_score + 1e-9 * sign(average_score), 1) AS avg1 FROM s)
SELECT request_id, CASE WHEN evidence_count = 0 THEN printf('Limited historical data for %s incidents in this context.', cause)
  ELSE printf('The AI learned that incidents with these characteristics historically evolve into %s-severity events. '
              || 'Based on %d similar historical incidents with an average impact of %s, the predicted score of %s aligns with observed patterns.',
              CASE WHEN avg1 >= 50 THEN 'high' ELSE 'moderate' END, evidence_count, CAST(avg1 AS VARCHAR),
              CAST(CAST(round_even(final_score, 0) AS BIGINT) AS VARCHAR)) END AS narrative FROM b""")
def q_impact_narrative(spark, sf):
    """Narrative text per request."""
    s = scored_requests(spark, sf)
    avg1 = round_half(F.col("average_score"), 1)
    return s.select("request_id", SC.impact_narrative(F.col("cause"), F.col("evidence_count"), avg1,
                                                      F.col("final_score")).alias("narrative"))


@query("predict_enriched", f"""
WITH {REQ_SQL}, {EVIDENCE_SQL}, {_STRESS_CTE},
s AS (SELECT *, CAST({BASELINE_SQL} AS DOUBLE) AS bs FROM evf),
b AS (SELECT *, {BLEND_SQL} AS final_score FROM s),
c AS (SELECT *, {CLASS.format(s='final_score')} AS risk_class FROM b),
{_res_sql('c', 'risk_class')[:-1]}),
cp AS (SELECT corridor, count(*) AS corridor_incidents, avg(requires_road_closure) * 100 AS corridor_closure_rate,
         CAST(sum(CASE WHEN impact_score >= 75 THEN 1 ELSE 0 END) AS BIGINT) AS corridor_critical_count
       FROM scored WHERE corridor <> 'Non-corridor' GROUP BY corridor),
hc AS (SELECT count(*) AS hc FROM inc WHERE event_cause = 'vehicle_breakdown'
        AND replace(lower(coalesce(veh_type, '')), ' ', '_') IN ('bmtc_bus', 'ksrtc_bus') AND corridor_tier = 1),
z AS (SELECT res.*, st.stress_index, cp.corridor_incidents, cp.corridor_closure_rate, cp.corridor_critical_count, hc.hc,
        round(average_score + 1e-9 * sign(average_score), 1) AS avg1,
        cause = 'vehicle_breakdown' AND replace(lower(coalesce(vehicle_type, '')), ' ', '_') IN ('bmtc_bus', 'ksrtc_bus') AND tier = 1 AS transit
      FROM res LEFT JOIN st ON res.corridor = st.corridor AND res.corridor <> 'Non-corridor'
      LEFT JOIN cp ON res.corridor = cp.corridor CROSS JOIN hc)
SELECT request_id, round(final_score, 6) AS final_score, risk_class, evidence_count, matching_count,
  CASE WHEN matching_count >= 30 THEN 'High' WHEN matching_count >= 10 THEN 'Medium' ELSE 'Low' END AS confidence,
  rung, critical_rate, average_score, CAST(n_low AS BIGINT) AS n_low, CAST(n_medium AS BIGINT) AS n_medium,
  CAST(n_high AS BIGINT) AS n_high, CAST(n_critical AS BIGINT) AS n_critical,
  CAST(bs AS INT) AS baseline_score, bs AS raw_model_output,
  concat_ws('; ', CASE WHEN closure = 1 THEN 'Road Closure:+35' END,
    CASE WHEN tier IN (1, 2, 3) THEN printf('Tier %d Corridor:+%d', tier, CASE tier WHEN 1 THEN 30 WHEN 2 THEN 20 ELSE 10 END) END,
    printf('Cause Severity (%s):+%d', cause, {SEV_SQL}),
    CASE WHEN hour BETWEEN 7 AND 10 OR hour BETWEEN 16 AND 20 THEN 'Rush Hour:+5' END,
    CASE WHEN hour >= 22 OR hour <= 5 THEN 'Night Hours:-5' END) AS components,
  CASE WHEN evidence_count = 0 THEN printf('Limited historical data for %s incidents in this context.', cause)
  ELSE printf('The AI learned that incidents with these characteristics historically evolve into %s-severity events. '
              || 'Based on %d similar historical incidents with an average impact of %s, the predicted score of %s aligns with observed patterns.',
              CASE WHEN avg1 >= 50 THEN 'high' ELSE 'moderate' END, evidence_count, CAST(avg1 AS VARCHAR),
              CAST(CAST(round_even(final_score, 0) AS BIGINT) AS VARCHAR)) END AS narrative,
  {RES_SELECT}, stress_index AS corridor_stress, corridor_incidents, corridor_closure_rate, corridor_critical_count,
  transit AS transit_triggered, CASE WHEN transit THEN hc END AS transit_cases, CASE WHEN transit THEN hc * 60 END AS transit_passengers
FROM z""")
def q_predict_enriched(spark, sf):
    """Full incident analysis for every request in one plan (J01–J05, M02–M06, M09, A29, G06): score and class,
    evidence with rate and distribution, baseline components, narrative, resources with multiplier texts, corridor profile
    and transit flag. Its lists are tables by request: ``resource_timeline``, ``barricade_placement``, ``evidence_examples``.
    The frozen model is absent, so the raw score is the baseline."""
    r = scored_requests(spark, sf).withColumn("confidence", EV.confidence_level())
    r = SC.resource_scaling(r)
    history = X.scored(spark, sf)
    profile = P.stress_index(history).select("corridor", F.col("stress_index").alias("corridor_stress"),
                                             F.col("frequency").alias("corridor_incidents"), F.col("closure_rate").alias("corridor_closure_rate"))
    crit = history.filter(F.col("corridor") != P.NON_CORRIDOR).groupBy("corridor").agg(
        F.sum(F.when(F.col("impact_score") >= 75, 1).otherwise(0)).cast("long").alias("corridor_critical_count"))
    r = r.join(profile.join(crit, "corridor"), "corridor", "left")
    r = EV.transit_chain(r, X.inc(spark, sf))
    avg1 = round_half(F.col("average_score"), 1)
    text = SC.impact_narrative(F.col("cause"), F.col("evidence_count"), avg1, F.col("final_score"))
    return r.select("request_id", "final_score", "risk_class", "evidence_count", "matching_count", "confidence", "rung", "critical_rate",
                    "average_score", "n_low", "n_medium", "n_high", "n_critical",
                    F.col("baseline_score").cast("int").alias("baseline_score"), F.col("baseline_score").alias("raw_model_output"),
                    "components", text.alias("narrative"), "police_units", "tow_trucks", "barricades", "special_team",
                    "diversion_required", "vehicle_note", "resolution_median", "resolution_range", "risk_multiplier", "tier_multiplier",
                    "total_multiplier", "corridor_stress", "corridor_incidents", "corridor_closure_rate", "corridor_critical_count",
                    F.col("triggered").alias("transit_triggered"), F.col("historical_cases").alias("transit_cases"),
                    F.col("estimated_passenger_disruption").alias("transit_passengers"))
