"""Input-quality and output-shape queries (P08, P13, P14, P16, P17, D11, G07, N02, A32, L06) over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import evidence as EV
from ..operators import feedback as FB
from ..operators import profiles as P
from ..operators import stats as S
from ..sources import fixtures as X
from .q_profiles import RISK_WINDOW_SQL
from .q_scoring import _LADDER_REQ_SQL, EVIDENCE_SQL, _ladder_requests
from .registry import query

# End coordinates of an incident (ours): missing for a quarter, zero for a quarter, else 0.01° north-east.
_END_SQL = """e AS (SELECT *, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE latitude + 0.01 END AS endlatitude,
  CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE longitude + 0.01 END AS endlongitude FROM inc)"""


def _end(c):
    return F.when(F.col("k") % 4 == 0, 0.0).when(F.col("k") % 4 != 1, F.col(c) + 0.01)


# Raw lines of the incidents (ours), of which some are damaged: cut short, too long, a coordinate or a time that reads as none.
_DAMAGE = "CASE WHEN k % 11 = 0 THEN 'short line' WHEN k % 11 = 1 THEN 'long line' WHEN k % 11 = 2 THEN 'wrong type' " \
          "WHEN k % 11 = 3 THEN 'unparsable time' WHEN k % 11 = 4 THEN 'no time' ELSE 'good' END"


def raw_lines(spark, sf):
    """Incidents as raw CSV lines with ``_DAMAGE``, and the header line."""
    from ..sources.files import RAW_INCIDENT_SCHEMA
    d = X.inc(spark, sf).withColumn("damage", F.expr(_DAMAGE))
    time = F.date_format("start_datetime", "yyyy-MM-dd HH:mm:ss")
    bad = F.col("damage")
    cols = [F.col("id").cast("string"), F.col("event_cause"), F.col("event_type"),
            F.when(bad == "unparsable time", "the day before").when(bad == "no time", "").otherwise(time), F.lit(""),
            F.when(bad == "wrong type", "north").otherwise(F.col("latitude").cast("string")), F.col("longitude").cast("string"), F.lit("0"), F.lit("0"),
            F.col("corridor"), F.coalesce("police_station", F.lit("")), F.coalesce("junction", F.lit("")), F.coalesce("veh_type", F.lit("")),
            F.when(F.col("requires_road_closure") == 1, "true").otherwise("false"), F.lit("yes"), F.lit('"a text, with a comma"')]
    whole, short = F.concat_ws(",", *cols), F.concat_ws(",", *cols[:9])
    line = F.when(bad == "short line", short).when(bad == "long line", F.concat(whole, F.lit(",one more"))).otherwise(whole)
    return d.select(line.alias("value")), ",".join(RAW_INCIDENT_SCHEMA.names)


@query("raw_csv_quarantine", f"SELECT {_DAMAGE} AS reason, count(*) AS n FROM inc GROUP BY 1")
def q_raw_csv_quarantine(spark, sf):
    """The incidents written as raw CSV files with damaged lines and read again; good and bad rows by reason."""
    from ..session import shared_path
    from ..sources.files import read_with_quarantine
    lines, header = raw_lines(spark, sf)
    path = shared_path(spark, "raw")
    lines.select(F.col("value").alias(header)).write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path)
    good, bad = read_with_quarantine(spark, path)
    return good.select(F.lit("good").alias("reason")).unionAll(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("data_quality_flags", f"""
WITH {_END_SQL}
SELECT id, CAST(coalesce(endlatitude <> 0, true) AND coalesce(endlongitude <> 0, true) AS INT) AS has_end_coords,
  CAST(latitude IS NOT NULL AND longitude IS NOT NULL AND endlatitude IS NOT NULL AND endlongitude IS NOT NULL AS INT) AS coords_complete
FROM e""")
def q_data_quality_flags(spark, sf):
    """P13."""
    has, full = R.data_quality_flags(_end("latitude"), _end("longitude"), F.col("latitude"), F.col("longitude"))
    return X.inc(spark, sf).select("id", has.alias("has_end_coords"), full.alias("coords_complete"))


_BAD_SQL = """b AS (SELECT id, corridor, CASE WHEN k % 7 = 0 THEN 0 WHEN k % 7 = 1 THEN NULL ELSE latitude END AS latitude,
  CASE WHEN k % 7 = 0 THEN 0 ELSE longitude END AS longitude FROM inc),
c AS (SELECT *, latitude IS NULL OR longitude IS NULL OR (latitude = 0 AND longitude = 0) AS bad FROM b)"""


def _bad(spark, sf):
    k = F.col("k") % 7
    return X.inc(spark, sf).select("id", "corridor", F.when(k == 0, 0.0).when(k != 1, F.col("latitude")).alias("latitude"),
                                   F.when(k == 0, 0.0).otherwise(F.col("longitude")).alias("longitude"))


@query("coordinate_fallback", f"""
WITH {_BAD_SQL}, m AS (SELECT corridor, avg(latitude) AS la, avg(longitude) AS lo FROM c WHERE NOT bad GROUP BY corridor)
SELECT id, CASE WHEN bad THEN la ELSE latitude END AS latitude, CASE WHEN bad THEN lo ELSE longitude END AS longitude
FROM c LEFT JOIN m USING (corridor)""")
def q_coordinate_fallback(spark, sf):
    """Invalid coordinates take the centroid of their corridor's valid ones."""
    d = _bad(spark, sf)
    valid = S.fallback_to_centroid(d, None, drop_invalid=True)
    centroids = valid.groupBy("corridor").agg(F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lon"))
    return S.fallback_to_centroid(d, centroids).select("id", "latitude", "longitude")


@query("coordinate_drop", f"WITH {_BAD_SQL} SELECT id, latitude, longitude FROM c WHERE NOT bad")
def q_coordinate_drop(spark, sf):
    """Invalid coordinates dropped."""
    return S.fallback_to_centroid(_bad(spark, sf), None, drop_invalid=True).select("id", "latitude", "longitude")


@query("nan_to_null", """
SELECT id, CASE WHEN k % 10 IN (0, 1, 2) THEN NULL ELSE duration_minutes END AS duration_minutes FROM inc""")
def q_nan_to_null(spark, sf):
    """NaN and ±infinity (planted by key) become NULL."""
    k = F.col("k") % 10
    dirty = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("duration_minutes"))
    return X.inc(spark, sf).select("id", R.nan_to_null(dirty).alias("duration_minutes"))


@query("end_imputation", """
WITH t AS (SELECT id, start_datetime AS s,
    CASE WHEN k % 3 = 0 THEN start_datetime + to_microseconds(CAST(round(duration_minutes * 60000000) AS BIGINT)) END AS e,
    CASE WHEN k % 3 = 1 THEN start_datetime + INTERVAL 90 MINUTE END AS r FROM inc),
d AS (SELECT id, (epoch_us(coalesce(e, r)) - epoch_us(s)) / 60000000.0 AS m FROM t)
SELECT id, coalesce(m, (SELECT median(m) FROM d)) AS duration_minutes FROM d""")
def q_end_imputation(spark, sf):
    """P17 + F14: a missing end takes the resolved time, what is left the exact median duration."""
    k, start = F.col("k") % 3, F.col("start_datetime").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + F.round(F.col("duration_minutes") * 60000000).cast("long"))
    d = X.inc(spark, sf).select("id", start.alias("start"), F.when(k == 0, end).alias("end"),
                                F.when(k == 1, start + F.expr("INTERVAL 90 MINUTES")).alias("resolved"))
    return S.impute_end(d, "start", "end", "resolved").select("id", "duration_minutes")


@query("holiday_flag", """
SELECT id, CASE WHEN CAST(start_datetime AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15', DATE '2024-01-26') THEN 1 ELSE 0 END AS is_holiday
FROM inc""")
def q_holiday_flag(spark, sf):
    """Holidays of a calendar dimension (three dates, one of them twice)."""
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-15",), ("2024-01-26",), ("2024-01-26",)], "date string")
    return S.with_holidays(X.inc(spark, sf), days).select("id", "is_holiday")


@query("prediction_ids", """
SELECT id, 'PRED_' || strftime(start_datetime, '%Y%m%d%H%M%S%f') AS id_stem, true AS has_hash FROM inc""")
def q_prediction_ids(spark, sf):
    """The id's time stem; a hash of the record follows it."""
    pid = FB.prediction_id(F.col("start_datetime").cast("timestamp"), F.col("id"), F.col("event_cause"))
    return X.inc(spark, sf).select("id", F.substring(pid, 1, 25).alias("id_stem"), pid.rlike("^PRED_[0-9]{20}_[0-9a-f]+$").alias("has_hash"))


@query("score_distribution", f"""
WITH {_LADDER_REQ_SQL}, {EVIDENCE_SQL}
SELECT cause, tier, closure, 'Low' AS class, CAST(n_low AS BIGINT) AS n FROM evf
UNION ALL SELECT cause, tier, closure, 'Medium', CAST(n_medium AS BIGINT) FROM evf
UNION ALL SELECT cause, tier, closure, 'High', CAST(n_high AS BIGINT) FROM evf
UNION ALL SELECT cause, tier, closure, 'Critical', CAST(n_critical AS BIGINT) FROM evf""")
def q_score_distribution(spark, sf):
    """The class distribution map of the evidence (zeros included), one row per entry."""
    ev = EV.evidence_lookup(_ladder_requests(spark, sf), X.scored(spark, sf))
    return ev.select("cause", "tier", "closure", F.explode("score_distribution").alias("class", "n"))


@query("slot_forecast_causes", """
SELECT corridor, weekday, hour, event_cause, n, CAST(rnk AS INT) AS rnk FROM
  (SELECT corridor, weekday, hour, event_cause, count(*) AS n,
     row_number() OVER (PARTITION BY corridor, weekday, hour ORDER BY count(*) DESC, event_cause) AS rnk
   FROM scored GROUP BY corridor, weekday, hour, event_cause) z WHERE rnk <= 3""")
def q_slot_forecast_causes(spark, sf):
    """The three commonest causes of every corridor slot."""
    return P.ranked_counts(X.scored(spark, sf), ["corridor", "weekday", "hour"], "event_cause", 3, count_col="n")


@query("risk_window_cell", f"WITH {RISK_WINDOW_SQL} SELECT * FROM rw WHERE weekday = 2 AND hour = 8")
def q_risk_window_cell(spark, sf):
    """One weekday and hour."""
    return P.slot_filter(P.risk_window(X.scored(spark, sf)), weekday=2, hour=8)


@query("residual_histogram", """
WITH x AS (SELECT actual_impact - predicted_impact AS v FROM plog WHERE actual_impact IS NOT NULL),
m AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 30)), 29) END AS INT) AS bin, lo, hi FROM x CROSS JOIN m)
SELECT bin, lo + bin * (hi - lo) / 30 AS bin_lo, lo + (bin + 1) * (hi - lo) / 30 AS bin_hi, count(*) AS n FROM b GROUP BY bin, lo, hi""")
def q_residual_histogram(spark, sf):
    """30-bin histogram of the residuals."""
    d = X.plog(spark, sf).filter(F.col("actual_impact").isNotNull())
    return S.histogram(d.select((F.col("actual_impact") - F.col("predicted_impact")).alias("residual")), "residual", 30)

