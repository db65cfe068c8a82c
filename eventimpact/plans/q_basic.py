"""Scans, cleaning, scalar functions and encodings (S, P, D, F, G, E rows of SURVEY §2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encoding as E
from ..functions import rules as R
from ..functions import temporal as T
from ..functions import text as G
from ..operators import stats as S
from ..sources import dims as D
from ..sources import fixtures as X
from ..sources.tables import read_table
from .oracle import sql_case_map, sql_values
from .registry import query

# ---------------------------------------------------------------- S / P


@query("scan_incidents", "SELECT * FROM inc")
def q_scan_incidents(spark, sf):
    """Parquet scan of the incident view (JSON property ``k`` extracted; pruning and pushdown by Catalyst)."""
    return X.inc(spark, sf)


@query("null_defaults", """
SELECT id, coalesce(event_cause, 'others') AS event_cause, coalesce(corridor, 'Non-corridor') AS corridor,
  coalesce(veh_type, 'unknown') AS veh_type, coalesce(police_station, 'unknown') AS police_station
FROM inc""")
def q_null_defaults(spark, sf):
    """Per-column NULL defaults."""
    return (X.inc(spark, sf).select("id", "event_cause", "corridor", "veh_type", "police_station")
            .fillna({"event_cause": "others", "corridor": "Non-corridor", "veh_type": "unknown",
                     "police_station": "unknown"}))


@query("valid_start", """
SELECT id, start_datetime, hour FROM inc WHERE start_datetime IS NOT NULL""")
def q_valid_start(spark, sf):
    """Keep rows whose start parsed."""
    return X.inc(spark, sf).filter(F.col("start_datetime").isNotNull()).select("id", "start_datetime", "hour")


@query("map_events", """
SELECT id, latitude, longitude, impact_score, event_cause, corridor FROM scored
WHERE latitude IS NOT NULL AND longitude IS NOT NULL
  AND latitude BETWEEN 12.5 AND 13.5 AND longitude BETWEEN 77.0 AND 78.0
ORDER BY md5(CAST(id AS VARCHAR)) LIMIT 500""")
def q_map_events(spark, sf):
    """P04 + P11 (T23): bounding box, then a deterministic hash-ordered sample of 500 map points."""
    d = X.scored(spark, sf).select("id", "latitude", "longitude", "impact_score", "event_cause", "corridor")
    d = d.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                 & F.col("latitude").between(12.5, 13.5) & F.col("longitude").between(77.0, 78.0))
    return d.orderBy(F.md5(F.col("id").cast("string"))).limit(500)


HIST_COLS = ["event_cause", "corridor", "corridor_tier", "requires_road_closure", "impact_score",
             "impact_class", "hour", "weekday", "veh_type", "police_station"]


@query("historical_index", """
SELECT event_cause, corridor, corridor_tier, requires_road_closure, impact_score,
  CASE WHEN impact_score >= 75 THEN 'Critical' WHEN impact_score >= 50 THEN 'High'
       WHEN impact_score >= 25 THEN 'Medium' ELSE 'Low' END AS impact_class,
  hour, weekday, veh_type, police_station
FROM scored""")
def q_historical_index(spark, sf):
    """Projection to the evidence columns that exist."""
    d = X.scored(spark, sf).withColumn("impact_class", R.risk_class(F.col("impact_score")))
    return d.select(*[c for c in HIST_COLS if c in d.columns])


@query("flag_normalise", """
SELECT id, CAST(CASE WHEN k % 3 = 0 THEN 'yes' ELSE 'no' END = 'yes' AS INT) AS authenticated,
  CAST(requires_road_closure > 0 AS INT) AS closure_flag
FROM inc""")
def q_flag_normalise(spark, sf):
    """P12: 'yes' → 1; boolean closure → 0/1."""
    d = X.inc(spark, sf)
    auth = F.when(F.col("k") % 3 == 0, "yes").otherwise("no")
    return d.select("id", (auth == "yes").cast("int").alias("authenticated"),
                    (F.col("requires_road_closure") > 0).cast("int").alias("closure_flag"))


@query("vehicle_standardise", f"""
SELECT id, veh_display,
  coalesce(replace(lower(coalesce({sql_case_map('veh_display', D.VEH_DISPLAY_MAP)}, veh_display)), ' ', '_'),
           'others') AS veh_key
FROM (SELECT id, CASE WHEN veh_type = 'bmtc_bus' THEN 'BMTC Bus' WHEN veh_type = 'truck' THEN 'Truck'
        WHEN veh_type = 'private_car' THEN 'Private Car' WHEN veh_type = 'ksrtc_bus' THEN 'KSRTC Bus'
        ELSE NULL END AS veh_display FROM inc) v""")
def q_vehicle_standardise(spark, sf):
    """Display names → keys."""
    d = X.inc(spark, sf)
    disp = (F.when(F.col("veh_type") == "bmtc_bus", "BMTC Bus").when(F.col("veh_type") == "truck", "Truck")
            .when(F.col("veh_type") == "private_car", "Private Car")
            .when(F.col("veh_type") == "ksrtc_bus", "KSRTC Bus"))
    d = d.select("id", disp.alias("veh_display"))
    return d.withColumn("veh_key", G.standardise_vehicle(F.col("veh_display"), D.VEH_DISPLAY_MAP))


_DOMAIN_ROWS = ([("corridor", c) for c in list(D.CORRIDOR_TIERS) + ["Non-corridor"]]
                + [("event_cause", c) for c in D.EVENT_CAUSES] + [("veh_type", v) for v in D.VEH_DISPLAY_MAP])


@query("metadata_domains", f"""
SELECT domain, value FROM {sql_values(_DOMAIN_ROWS, ['domain', 'value'])}
UNION ALL
SELECT DISTINCT 'station' AS domain, police_station AS value FROM inc WHERE police_station IS NOT NULL""")
def q_metadata_domains(spark, sf):
    """Selector domains — fixed lists plus the sorted distinct stations."""
    const = spark.createDataFrame(_DOMAIN_ROWS, "domain string, value string")
    st = (X.inc(spark, sf).filter(F.col("police_station").isNotNull())
          .select(F.lit("station").alias("domain"), F.col("police_station").alias("value")).distinct())
    return const.unionByName(st).orderBy("domain", "value")


@query("planned_events_view", """
SELECT *, CAST(strptime(CAST(event_date AS VARCHAR) || ' ' || lpad(CAST(hour AS VARCHAR), 2, '0') || ':00',
                        '%Y-%m-%d %H:%M') AS TIMESTAMP) AS event_datetime
FROM plan""")
def q_planned_events_view(spark, sf):
    """Calendar rows with ``datetime`` built from date and start-time text."""
    p = X.plan(spark, sf)
    txt = F.concat_ws(" ", F.col("event_date").cast("string"), F.format_string("%02d:00", F.col("hour")))
    return p.withColumn("event_datetime", F.to_timestamp(txt, "yyyy-MM-dd HH:mm"))


# ---------------------------------------------------------------- D


@query("temporal_parts", """
SELECT id, CAST(hour(start_datetime) AS INT) AS hour, CAST(isodow(start_datetime) - 1 AS INT) AS weekday,
  CAST(month(start_datetime) AS INT) AS month, CAST(day(start_datetime) AS INT) AS day_of_month
FROM inc""")
def q_temporal_parts(spark, sf):
    """D01."""
    d = X.inc(spark, sf)
    parts = T.temporal_parts(F.col("start_datetime"))
    return d.select("id", *[c.alias(n) for n, c in parts.items()])


@query("temporal_flags", """
SELECT id,
  CASE WHEN weekday >= 5 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour < 6 OR hour > 22 THEN 1 ELSE 0 END AS is_night_code,
  CASE WHEN hour >= 22 OR hour <= 5 THEN 1 ELSE 0 END AS is_night_serving,
  CASE WHEN hour BETWEEN 7 AND 9 THEN 1 ELSE 0 END AS is_morning_peak,
  CASE WHEN hour BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS is_evening_peak,
  CASE WHEN hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS is_peak_code,
  CASE WHEN hour BETWEEN 7 AND 10 OR hour BETWEEN 16 AND 20 THEN 1 ELSE 0 END AS is_peak_rush,
  CASE WHEN hour IN (8, 9, 17, 18, 19) THEN 1 ELSE 0 END AS is_peak_sim,
  CASE WHEN hour BETWEEN 8 AND 10 OR hour BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS is_peak_client
FROM inc""")
def q_temporal_flags(spark, sf):
    """D02, D03, D04 with every variant of T6/T7."""
    d = X.inc(spark, sf)
    h = F.col("hour")
    return d.select("id", T.is_weekend(F.col("weekday")).alias("is_weekend"),
                    T.is_night(h, "code").alias("is_night_code"), T.is_night(h, "serving").alias("is_night_serving"),
                    T.morning_peak(h).alias("is_morning_peak"), T.evening_peak(h).alias("is_evening_peak"),
                    T.is_peak(h, "code").alias("is_peak_code"), T.is_peak(h, "rush").alias("is_peak_rush"),
                    T.is_peak(h, "sim").alias("is_peak_sim"), T.is_peak(h, "client").alias("is_peak_client"))


@query("cyclical_encoding", """
SELECT id,
  round(sin(2 * pi() * hour / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour / 24), 6) + 0.0 AS hour_cos,
  round(sin(2 * pi() * weekday / 7), 6) + 0.0 AS weekday_sin, round(cos(2 * pi() * weekday / 7), 6) + 0.0 AS weekday_cos,
  round(sin(2 * pi() * month / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month / 12), 6) + 0.0 AS month_cos
FROM inc""")
def q_cyclical_encoding(spark, sf):
    """D05 (T17: weekday_cos uses cos)."""
    d = X.inc(spark, sf)
    cols = ["id"]
    for c, p in (("hour", 24), ("weekday", 7), ("month", 12)):
        s, co = T.cyclical(F.col(c), p)
        cols += [(F.round(s, 6) + 0.0).alias(f"{c}_sin"), (F.round(co, 6) + 0.0).alias(f"{c}_cos")]
    return d.select(*cols)


@query("duration_minutes", """
SELECT l_orderkey, l_linenumber,
  round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 60000000.0, 6) AS duration_minutes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q_duration_minutes(spark, sf):
    """Minutes between order date and ship date (negative on dirty rows). Shuffle join on the order key."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber",
                    T.duration_minutes(F.col("o_orderdate"), F.col("l_shipdate")).alias("duration_minutes"))


@query("hour_shape", """
SELECT id, abs(hour - 12) AS hour_deviation, CASE WHEN hour <= 3 OR hour >= 22 THEN 1 ELSE 0 END AS is_extreme_hour
FROM inc""")
def q_hour_shape(spark, sf):
    """D07."""
    d = X.inc(spark, sf)
    return d.select("id", T.hour_deviation(F.col("hour")).alias("hour_deviation"),
                    T.is_extreme_hour(F.col("hour")).alias("is_extreme_hour"))


_INTENSITY_SQL = sql_case_map("hour", D.HOUR_INTENSITY)
_WEIGHT_SQL = sql_case_map("weekday", D.WEEKDAY_WEIGHT)


@query("temporal_score", f"""
SELECT id, {_INTENSITY_SQL} AS traffic_intensity, {_WEIGHT_SQL} AS weekday_weight,
  round({_INTENSITY_SQL} * {_WEIGHT_SQL}, 6) AS temporal_score
FROM inc""")
def q_temporal_score(spark, sf):
    """D08."""
    d = X.inc(spark, sf)
    h, w = F.col("hour"), F.col("weekday")
    return d.select("id", T.traffic_intensity(h).alias("traffic_intensity"),
                    T.weekday_weight(w).alias("weekday_weight"), T.temporal_score(h, w).alias("temporal_score"))


@query("shift_bucket", """
SELECT id, CASE WHEN hour >= 6 AND hour < 14 THEN 'Morning' WHEN hour >= 14 AND hour < 22 THEN 'Evening'
  ELSE 'Night' END AS shift,
  CASE WHEN hour >= 6 AND hour < 14 THEN '06:00 - 14:00' WHEN hour >= 14 AND hour < 22 THEN '14:00 - 22:00'
  ELSE '22:00 - 06:00' END AS shift_label
FROM inc""")
def q_shift_bucket(spark, sf):
    """D09."""
    d = X.inc(spark, sf).withColumn("shift", T.shift_name(F.col("hour")))
    return d.select("id", "shift", T.shift_label(F.col("shift")).alias("shift_label"))


@query("moon_phase_days", """
SELECT id, round(((date_diff('day', DATE '2000-01-06', CAST(start_datetime AS DATE)) % 29.530588853 + 29.530588853)
   % 29.530588853) / 29.530588853, 6) AS moon_phase
FROM inc""")
def q_moon_phase(spark, sf):
    """D12 (definition ours): synodic-month phase of the start date."""
    d = X.inc(spark, sf)
    return d.select("id", T.moon_phase(F.col("start_datetime")).alias("moon_phase"))


# ---------------------------------------------------------------- F

_PT = D.DEFAULT_POINT


@query("haversine_distance", f"""
SELECT id, round(km, 6) AS km, CAST(trunc(km / 30 * 60) AS INT) AS travel_minutes FROM (
  SELECT id, 6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM (
    SELECT id, pow(sin(radians({_PT[0]} - latitude) / 2), 2)
      + cos(radians(latitude)) * cos(radians({_PT[0]})) * pow(sin(radians({_PT[1]} - longitude) / 2), 2) AS a
    FROM inc) x) y""")
def q_haversine(spark, sf):
    """F04 + F05: distance of each incident to the city point and the truncated travel minutes."""
    d = X.inc(spark, sf)
    km = R.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(_PT[0]), F.lit(_PT[1]))
    return d.select("id", km.alias("km")).withColumn("travel_minutes", R.travel_minutes(F.col("km")))


@query("geo_bins", """
SELECT id,
  CAST(CASE WHEN latitude IS NULL THEN 0 WHEN la1 = la0 THEN 4
       ELSE least(greatest(ceil((latitude - la0) / (la1 - la0) * 10) - 1, 0), 9) END AS INT) AS lat_bin,
  CAST(CASE WHEN longitude IS NULL THEN 0 WHEN lo1 = lo0 THEN 4
       ELSE least(greatest(ceil((longitude - lo0) / (lo1 - lo0) * 10) - 1, 0), 9) END AS INT) AS lon_bin,
  floor(latitude * 100 + 0.5) / 100 AS lat_r2, floor(longitude * 100 + 0.5) / 100 AS lon_r2
FROM inc CROSS JOIN (SELECT min(latitude) AS la0, max(latitude) AS la1, min(longitude) AS lo0,
                            max(longitude) AS lo1 FROM inc) m""")
def q_geo_bins(spark, sf):
    """F08 (right-closed 10 bins, NULL → 0) and F09 (2-digit spatial bin, half-up on the decimal value)."""
    d = X.inc(spark, sf).select("id", "latitude", "longitude")
    d = S.equal_width_bin(d, "latitude", "lat_bin")
    d = S.equal_width_bin(d, "longitude", "lon_bin")
    return d.select("id", "lat_bin", "lon_bin",
                    (F.floor(F.col("latitude") * 100 + 0.5) / 100).alias("lat_r2"),
                    (F.floor(F.col("longitude") * 100 + 0.5) / 100).alias("lon_r2"))


@query("interaction_features", f"""
SELECT id,
  requires_road_closure * corridor_tier AS closure_tier, pk * corridor_tier AS peak_tier,
  wk * corridor_tier AS weekend_tier, requires_road_closure * pk AS closure_peak,
  round(requires_road_closure * ts, 6) AS closure_temporal, corridor_tier * corridor_tier AS tier_squared,
  round(corridor_tier * ts, 6) AS tier_temporal, round(requires_road_closure * corridor_tier * ts, 6) AS closure_tier_temporal,
  requires_road_closure * pk * corridor_tier AS closure_peak_tier, round(ti * corridor_tier, 6) AS intensity_tier,
  pk * wk AS peak_weekend, sc * corridor_tier AS script_tier
FROM (SELECT inc.*, CASE WHEN regexp_matches(coalesce(d.text, ''), '[\u0C80-\u0CFF]') THEN 1 ELSE 0 END AS sc, CASE WHEN hour IN (7, 8, 9, 17, 18, 19) THEN 1 ELSE 0 END AS pk,
        CASE WHEN weekday >= 5 THEN 1 ELSE 0 END AS wk, {_INTENSITY_SQL} AS ti,
        {_INTENSITY_SQL} * {_WEIGHT_SQL} AS ts FROM inc LEFT JOIN documents d ON inc.id = d.doc_id) x""")
def q_interaction_features(spark, sf):
    """the twelve interaction products (the description is the document of the incident's id)."""
    d = X.inc(spark, sf).join(read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "left")
    c, t = F.col("requires_road_closure"), F.col("corridor_tier")
    pk = T.is_peak(F.col("hour"), "code")
    wk = T.is_weekend(F.col("weekday"))
    ts = T.temporal_score(F.col("hour"), F.col("weekday"))
    ti = T.traffic_intensity(F.col("hour"))
    return d.select("id", (c * t).alias("closure_tier"), (pk * t).alias("peak_tier"), (wk * t).alias("weekend_tier"),
                    (c * pk).alias("closure_peak"), (c * ts).alias("closure_temporal"), (t * t).alias("tier_squared"),
                    (t * ts).alias("tier_temporal"), (c * t * ts).alias("closure_tier_temporal"),
                    (c * pk * t).alias("closure_peak_tier"), (ti * t).alias("intensity_tier"),
                    (pk * wk).alias("peak_weekend"), (G.has_script(F.col("text")) * t).alias("script_tier"))


@query("risk_classes", """
SELECT id, impact_score,
  CASE WHEN impact_score >= 75 THEN 'Critical' WHEN impact_score >= 50 THEN 'High'
       WHEN impact_score >= 25 THEN 'Medium' ELSE 'Low' END AS impact_class,
  CASE WHEN impact_score >= 80 THEN 'Critical' WHEN impact_score >= 60 THEN 'High'
       WHEN impact_score >= 40 THEN 'Medium' ELSE 'Low' END AS impact_class_eval
FROM scored""")
def q_risk_classes(spark, sf):
    """Both boundary sets."""
    d = X.scored(spark, sf)
    s = F.col("impact_score")
    return d.select("id", "impact_score", R.risk_class(s).alias("impact_class"),
                    R.risk_class(s, (80, 60, 40)).alias("impact_class_eval"))


_TIER_NAMES = list(D.CORRIDOR_TIERS)
_NAME_SQL = ("CASE WHEN user_id % 24 < 21 THEN " + "[" + ", ".join(f"'{n}'" for n in _TIER_NAMES) + "][user_id % 24 + 1]"
             " WHEN user_id % 24 = 21 THEN 'Bannerghata Road' WHEN user_id % 24 = 22 THEN 'Non-corridor' ELSE NULL END")


def named_corridors(spark, sf):
    """Incidents carrying real corridor names (21 mapped, one misspelt, Non-corridor, NULL)."""
    e = read_table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id")
    return e.select("id", X.corridor_name(F.col("user_id")).alias("corridor"))


@query("corridor_tier", f"""
SELECT id, corridor,
  CAST(CASE WHEN corridor IS NULL OR corridor = 'Non-corridor' THEN 0 ELSE coalesce(t.tier, 0) END AS INT) AS tier_features,
  CAST(CASE WHEN corridor IS NULL OR corridor IN ('Non-corridor', '') THEN 0 ELSE coalesce(t.tier, 3) END AS INT) AS tier_serving,
  CASE WHEN coalesce(corridor, 'Non-corridor') <> 'Non-corridor' THEN 1 ELSE 0 END AS is_corridor_name,
  CASE WHEN coalesce(t.tier, 0) > 0 THEN 1 ELSE 0 END AS is_corridor_tier
FROM (SELECT event_id AS id, {_NAME_SQL} AS corridor FROM events) e
LEFT JOIN {sql_values(list(D.CORRIDOR_TIERS.items()), ['tname', 'tier'])} ON e.corridor = t.tname""")
def q_corridor_tier(spark, sf):
    """Broadcast join to the 21-row tier dimension with both defaults."""
    d = named_corridors(spark, sf)
    dim = F.broadcast(D.corridor_tier_dim(spark).withColumnRenamed("corridor", "tname"))
    j = d.join(dim, d.corridor == dim.tname, "left")
    c = F.col("corridor")
    nonc = c.isNull() | (c == "Non-corridor")
    return j.select(
        "id", "corridor",
        F.when(nonc, 0).otherwise(F.coalesce("tier", F.lit(0))).cast("int").alias("tier_features"),
        F.when(nonc | (c == ""), 0).otherwise(F.coalesce("tier", F.lit(3))).cast("int").alias("tier_serving"),
        F.when(F.coalesce(c, F.lit("Non-corridor")) != "Non-corridor", 1).otherwise(0).alias("is_corridor_name"),
        F.when(F.coalesce("tier", F.lit(0)) > 0, 1).otherwise(0).alias("is_corridor_tier"))


@query("impact_score_v2", """
SELECT id, dur, is_peak_hour, impact_score FROM scored""")
def q_impact_v2(spark, sf):
    """F14 + F15 + F01: median-imputed duration and the clipped code label."""
    return X.scored(spark, sf).select("id", "dur", "is_peak_hour", "impact_score")


@query("impact_score_v1", """
SELECT id, least(100, greatest(0, requires_road_closure * 50
  + CASE corridor_tier WHEN 1 THEN 30 WHEN 2 THEN 22 WHEN 3 THEN 14 ELSE 0 END
  + CASE WHEN dur > 360 THEN 20 WHEN dur > 120 THEN 14 WHEN dur > 60 THEN 7 ELSE 0 END)) AS impact_score_v1
FROM scored""")
def q_impact_v1(spark, sf):
    """F16: documented label."""
    d = X.scored(spark, sf)
    return d.select("id", R.impact_score_v1(F.col("dur"), F.col("requires_road_closure"),
                                            F.col("corridor_tier")).alias("impact_score_v1"))


@query("cause_severity", f"""
SELECT id, event_cause,
  coalesce({sql_case_map('event_cause', D.CAUSE_SEVERITY)}, 5) AS sev_base,
  coalesce({sql_case_map('event_cause', D.CAUSE_SEVERITY_T2)}, 6) AS sev_t2,
  coalesce({sql_case_map('event_cause', D.CAUSE_SEVERITY_M5)}, 7) AS sev_m5,
  coalesce({sql_case_map('event_cause', D.CAUSE_SEVERITY_M6)}, 5) AS sev_m6
FROM (SELECT id, CASE WHEN k % 7 = 0 THEN 'fire' ELSE event_cause END AS event_cause FROM inc) x""")
def q_cause_severity(spark, sf):
    """Four severity maps with their defaults (one unmapped cause per seventh row)."""
    d = X.inc(spark, sf).select("id", F.when(F.col("k") % 7 == 0, "fire").otherwise(F.col("event_cause"))
                                .alias("event_cause"))
    c = F.col("event_cause")
    return d.select("id", "event_cause", *[R.cause_severity(c, v).alias(f"sev_{v}") for v in ("base", "t2", "m5", "m6")])


@query("cause_cluster", """
SELECT id, CASE WHEN event_cause IN ('protest', 'water_logging', 'tree_fall', 'accident') THEN 3
  WHEN event_cause IN ('public_event', 'procession', 'vip_movement', 'construction', 'road_conditions') THEN 2
  ELSE 1 END AS cause_cluster
FROM inc""")
def q_cause_cluster(spark, sf):
    """F18."""
    return X.inc(spark, sf).select("id", R.cause_cluster(F.col("event_cause")).alias("cause_cluster"))


# ---------------------------------------------------------------- G


@query("script_detect", r"""
SELECT doc_id,
  CASE WHEN text IS NULL OR text = '' THEN 0 WHEN regexp_matches(text, '[\x{00C0}-\x{00FF}]') THEN 1 ELSE 0 END AS has_script,
  CASE WHEN regexp_matches(text, '[^\x{0000}-\x{007F}]') THEN 1 ELSE 0 END AS non_ascii
FROM documents""")
def q_script_detect(spark, sf):
    """G01 + G02 over whole documents; the range is a parameter (Latin-1 letters here: no Kannada in the data)."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", G.has_script(F.col("text"), "00C0", "00FF").alias("has_script"),
                    G.is_non_ascii(F.col("text")).alias("non_ascii"))


@query("text_quality", r"""
SELECT doc_id, coalesce(length(text), 0) AS text_length,
  CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')), 0) AS INT) AS word_count
FROM documents""")
def q_text_quality(spark, sf):
    """Character length and whitespace word count of whole texts."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", G.text_length(F.col("text")).cast("long").alias("text_length"),
                    G.word_count(F.col("text")).alias("word_count"))


# ---------------------------------------------------------------- E


@query("label_encode", """
WITH x AS (SELECT id, event_cause, coalesce(veh_type, 'unknown') AS veh, corridor,
             coalesce(police_station, 'unknown') AS station,
             concat_ws('_', event_cause, corridor) AS cause_corridor FROM inc)
SELECT id,
  CAST(dense_rank() OVER (ORDER BY event_cause) - 1 AS INT) AS event_cause_encoded,
  CAST(dense_rank() OVER (ORDER BY veh) - 1 AS INT) AS veh_type_encoded,
  CAST(dense_rank() OVER (ORDER BY corridor) - 1 AS INT) AS corridor_encoded,
  CAST(dense_rank() OVER (ORDER BY station) - 1 AS INT) AS station_encoded,
  CAST(dense_rank() OVER (ORDER BY cause_corridor) - 1 AS INT) AS cause_corridor_encoded
FROM x""")
def q_label_encode(spark, sf):
    """E01 + G04: alphabetical codes of five columns (NULL → 'unknown'), composite ``cause_corridor`` key."""
    d = X.inc(spark, sf).select("id", "event_cause", "veh_type", "corridor", "police_station")
    d = d.withColumn("cause_corridor", G.composite_key(F.col("event_cause"), F.col("corridor")))
    d = E.label_encode(d, {"event_cause_encoded": ("event_cause", None), "veh_type_encoded": ("veh_type", "unknown"),
                           "corridor_encoded": ("corridor", None), "station_encoded": ("police_station", "unknown"),
                           "cause_corridor_encoded": ("cause_corridor", None)})
    return d.select("id", "event_cause_encoded", "veh_type_encoded", "corridor_encoded", "station_encoded",
                    "cause_corridor_encoded")


@query("appearance_encode", """
WITH f AS (SELECT event_cause, min(start_datetime) AS t, min_by(id, (start_datetime, id)) AS fid FROM inc GROUP BY event_cause),
c AS (SELECT event_cause, CAST(row_number() OVER (ORDER BY t, fid) - 1 AS INT) AS event_cause_code FROM f),
g AS (SELECT corridor, min(start_datetime) AS t, min_by(id, (start_datetime, id)) AS fid FROM inc GROUP BY corridor),
h AS (SELECT corridor, CAST(row_number() OVER (ORDER BY t, fid) - 1 AS INT) AS corridor_code FROM g)
SELECT i.id, c.event_cause_code, h.corridor_code FROM inc i JOIN c USING (event_cause) JOIN h USING (corridor)""")
def q_appearance_encode(spark, sf):
    """First-appearance codes in (start, id) order."""
    d = X.inc(spark, sf).select("id", "event_cause", "corridor", "start_datetime")
    d = E.appearance_encode(d, "event_cause", "event_cause_code", ["start_datetime", "id"])
    d = E.appearance_encode(d, "corridor", "corridor_code", ["start_datetime", "id"])
    return d.select("id", "event_cause_code", "corridor_code")


@query("standard_scale", f"""
WITH x AS (SELECT id, coalesce(duration_minutes, 0) AS dm,
             CAST(coalesce({sql_case_map('event_cause', D.CAUSE_SEVERITY)}, 5) AS DOUBLE) AS sev,
             CAST(hour AS DOUBLE) AS hr FROM inc),
m AS (SELECT avg(dm) AS m1, stddev_pop(dm) AS s1, avg(sev) AS m2, stddev_pop(sev) AS s2,
             avg(hr) AS m3, stddev_pop(hr) AS s3 FROM x)
SELECT id, round((dm - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS duration_minutes_scaled,
  round((sev - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS cause_base_severity_scaled,
  round((hr - m3) / CASE WHEN s3 = 0 THEN 1 ELSE s3 END, 6) AS hour_scaled
FROM x CROSS JOIN m""")
def q_standard_scale(spark, sf):
    """Population-std scaling, NULL → 0 first, zero std → 1."""
    d = X.inc(spark, sf).select("id", "duration_minutes", R.cause_severity(F.col("event_cause")).alias("cause_base_severity"),
                                "hour")
    d = S.standard_scale(d, ["duration_minutes", "cause_base_severity", "hour"])
    return d.select("id", "duration_minutes_scaled", "cause_base_severity_scaled", "hour_scaled")


@query("percentile_rank", f"""
WITH x AS (SELECT id, {_INTENSITY_SQL} * {_WEIGHT_SQL} AS ts, duration_minutes FROM inc)
SELECT id,
  round((rank() OVER (ORDER BY ts) + (count(*) OVER (PARTITION BY ts) - 1) / 2.0) / count(*) OVER (), 6) AS temporal_percentile,
  CASE WHEN duration_minutes IS NULL THEN NULL ELSE round((rank() OVER (PARTITION BY duration_minutes IS NULL ORDER BY duration_minutes)
     + (count(*) OVER (PARTITION BY duration_minutes) - 1) / 2.0) / count(duration_minutes) OVER (), 6) END AS duration_percentile
FROM x""")
def q_percentile_rank(spark, sf):
    """Average-tie percentile rank (pandas ``rank(pct=True)``), NULLs stay NULL."""
    d = X.inc(spark, sf).select("id", T.temporal_score(F.col("hour"), F.col("weekday")).alias("ts"), "duration_minutes")
    d = S.percentile_rank(d, "ts", "temporal_percentile")
    d = S.percentile_rank(d, "duration_minutes", "duration_percentile")
    return d.select("id", "temporal_percentile", "duration_percentile")


@query("stress_index_minmax", """
WITH g AS (SELECT corridor, count(*) AS total_incidents, sum(requires_road_closure) AS closures,
             median(dur) / 60 AS median_resolution FROM scored WHERE corridor <> 'Non-corridor' GROUP BY corridor),
h AS (SELECT *, closures * 100.0 / total_incidents AS closure_rate FROM g),
m AS (SELECT min(total_incidents) a0, max(total_incidents) a1, min(closure_rate) b0, max(closure_rate) b1,
             min(median_resolution) c0, max(median_resolution) c1 FROM h)
SELECT corridor, total_incidents, CAST(closures AS BIGINT) AS closures, round(median_resolution, 6) AS median_resolution,
  round(closure_rate, 6) AS closure_rate,
  round((0.4 * CASE WHEN a1 = a0 THEN 0 ELSE (total_incidents - a0) / (a1 - a0) END
       + 0.4 * CASE WHEN b1 = b0 THEN 0 ELSE (closure_rate - b0) / (b1 - b0) END
       + 0.2 * CASE WHEN c1 = c0 THEN 0 ELSE (median_resolution - c0) / (c1 - c0) END) * 100, 6) AS stress_index
FROM h CROSS JOIN m ORDER BY stress_index DESC, corridor LIMIT 15""")
def q_stress_index_minmax(spark, sf):
    """Min-max stress variant (frequency, closure rate, median resolution hours), top 15."""
    from ..operators.profiles import NON_CORRIDOR
    d = X.scored(spark, sf).filter(F.col("corridor") != NON_CORRIDOR)
    g = d.groupBy("corridor").agg(F.count(F.lit(1)).alias("total_incidents"),
                                  F.sum("requires_road_closure").cast("long").alias("closures"))
    g = S.with_quantiles(g, S.exact_quantiles(d, "dur", [0.5], ["corridor"], ["median_resolution"]), ["corridor"])
    g = g.withColumn("median_resolution", F.col("median_resolution") / 60)
    g = g.withColumn("closure_rate", F.col("closures") * 100.0 / F.col("total_incidents"))
    g = S.minmax_scale(g, ["total_incidents", "closure_rate", "median_resolution"])
    st = (0.4 * F.col("total_incidents_mm") + 0.4 * F.col("closure_rate_mm") + 0.2 * F.col("median_resolution_mm")) * 100
    return (g.select("corridor", "total_incidents", "closures", "median_resolution", "closure_rate", st.alias("stress_index"))
            .orderBy(F.desc("stress_index"), "corridor").limit(15))


_TARGETS_SQL = f"""
WITH x AS (SELECT id, requires_road_closure AS c, corridor_tier AS t, event_cause AS cause,
             CASE WHEN hour IN (7, 8, 9, 17, 18, 19) THEN 1 ELSE 0 END AS pk, CASE WHEN weekday >= 5 THEN 1 ELSE 0 END AS wk,
             {_INTENSITY_SQL} AS ti, {_INTENSITY_SQL} * {_WEIGHT_SQL} AS ts, coalesce(length(d.text), 0) AS dl,
             CASE WHEN regexp_matches(coalesce(d.text, ''), '[\u0C80-\u0CFF]') THEN 1 ELSE 0 END AS sc
      FROM inc LEFT JOIN documents d ON inc.id = d.doc_id),
y AS (SELECT *, (rank() OVER (ORDER BY ts) + (count(*) OVER (PARTITION BY ts) - 1) / 2.0) / count(*) OVER () AS tp,
             (rank() OVER (ORDER BY dl) + (count(*) OVER (PARTITION BY dl) - 1) / 2.0) / count(*) OVER () AS dp FROM x)
"""
_TARGET_SQL = {
    "v1": f"""CAST(c * 55 + t * 12 + c * t * 10 + pk * 7 AS DOUBLE)""",
    "v2": f"""coalesce({sql_case_map('cause', D.CAUSE_SEVERITY_T2)}, 6) * 1.5 + c * 35 + t * 10 + pk * 8 - wk * 4 + sc * 3 + ts * 15""",
    "v3": f"""c * 50 + pow(t, 1.5) * 8 + pow(ti, 2) * 12 + c * t * 15 + pk * t * 6 + ln(1 + dl) * 2""",
    "m4": f"""CASE WHEN cause IN ('protest', 'water_logging', 'tree_fall', 'accident') THEN 3
      WHEN cause IN ('public_event', 'procession', 'vip_movement', 'construction', 'road_conditions') THEN 2 ELSE 1 END * 18
    + pow(c, 1.2) * 42 + pow(t, 1.3) * 9 + exp(ts) * 5 + pk * 6 + sc * 2.5 + ln(1 + dl) * 1.5""",
    "m5": f"""coalesce({sql_case_map('cause', D.CAUSE_SEVERITY_M5)}, 7) * 0.8 + c * 40 * 1.1 + (t / 3 * 25) * 0.9
    + tp * 20 + dp * 10 * 0.5 + sc * 3.5 + pk * 5""",
    "m6": f"""coalesce({sql_case_map('cause', D.CAUSE_SEVERITY_M6)}, 5) * 1.3 + c * 32 + t * 11 + c * t * 12
    + c * t * ts * 8 + c * pk * t * 4 + ts * 14 + sc * t * 2 + ti * t * 3 + pk * 7 - wk * 3""",
}


def _noise_sql(name: str) -> str:
    mean, sd = R.TARGET_NOISE[name]
    u = "(CAST('0x' || substr(md5('{n}:' || id), {at}, 13) AS BIGINT) + 0.5) / 4503599627370496"
    return f"{mean} + {sd} * sqrt(-2 * ln({u.format(n=name, at=1)})) * cos(2 * pi() * {u.format(n=name, at=14)})"


@query("target_formulas", _TARGETS_SQL + "SELECT id, " + ", ".join(
    f"least(100.0, greatest(0.0, {e})) AS {n}" for n, e in _TARGET_SQL.items()) + " FROM y")
def q_target_formulas(spark, sf):
    """The six candidate targets (noise off); an incident's description is the document of its id."""
    return trial_targets(spark, sf)


@query("target_formulas_noisy", _TARGETS_SQL + "SELECT id, " + ", ".join(
    f"least(100.0, greatest(0.0, {e} + {_noise_sql(n)})) AS {n}" for n, e in _TARGET_SQL.items()) + " FROM y")
def q_target_formulas_noisy(spark, sf):
    """the six candidate targets with their seeded Gaussian noise."""
    return noisy_targets(spark, sf)


def noisy_targets(spark, sf):
    return trial_targets(spark, sf, F.col("id"))


def trial_targets(spark, sf, noise_key=None):
    text = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    d = X.inc(spark, sf).join(text, "id", "left")
    h, w = F.col("hour"), F.col("weekday")
    d = d.select("id", "requires_road_closure", "corridor_tier", "event_cause", T.is_peak(h, "code").alias("pk"),
                 T.is_weekend(w).alias("wk"), T.traffic_intensity(h).alias("ti"), T.temporal_score(h, w).alias("ts"),
                 G.text_length(F.col("text")).alias("desc_len"), G.has_script(F.col("text")).alias("script"))
    d = S.percentile_rank(d, "ts", "tp")
    d = S.percentile_rank(d, "desc_len", "dp")
    f = R.target_formulas(F.col("requires_road_closure"), F.col("corridor_tier"), F.col("pk"), F.col("wk"), F.col("ti"),
                          F.col("ts"), F.col("event_cause"), F.col("script"), F.col("desc_len"), F.col("tp"), F.col("dp"), noise_key)
    return d.select("id", *[v.alias(k) for k, v in f.items()])
