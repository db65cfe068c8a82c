"""Window-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.clustering import dbscan
from ..sources import fixtures as X
from .oracle import GEO_SQL
from .registry import query


@query("frequency_features", """
SELECT id,
  CASE WHEN police_station IS NULL THEN NULL
       ELSE row_number() OVER (PARTITION BY police_station ORDER BY start_datetime, id) - 1 END AS station_event_count,
  CASE WHEN junction IS NULL THEN NULL
       ELSE row_number() OVER (PARTITION BY junction ORDER BY start_datetime, id) - 1 END AS junction_event_count,
  row_number() OVER (PARTITION BY corridor ORDER BY start_datetime, id) - 1 AS corridor_event_count
FROM inc""")
def q_frequency_features(spark, sf):
    """Prior-event counts per station, junction and corridor (order lives inside the windows)."""
    d = X.inc(spark, sf).select("id", "start_datetime", "police_station", "junction", "corridor")
    d = W.prior_count(d, "police_station", "station_event_count")
    d = W.prior_count(d, "junction", "junction_event_count")
    d = W.prior_count(d, "corridor", "corridor_event_count")
    return d.select("id", "station_event_count", "junction_event_count", "corridor_event_count")


@query("expanding_closure_rate", """
SELECT id,
  avg(requires_road_closure) OVER (PARTITION BY event_cause ORDER BY start_datetime, id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS closure_rate_incl,
  coalesce(avg(requires_road_closure) OVER (PARTITION BY event_cause ORDER BY start_datetime, id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closure_rate_prior
FROM inc""")
def q_expanding_closure_rate(spark, sf):
    """Expanding closure rate per cause, with (reference) and without (leak-free) the current row."""
    d = X.inc(spark, sf).select("id", "start_datetime", "event_cause", "requires_road_closure")
    d = W.expanding_rate(d, "event_cause", "requires_road_closure", "closure_rate_incl", "closure_rate_prior")
    return d.select("id", "closure_rate_incl", "closure_rate_prior")


@query("events_last_7days", f"""
WITH RECURSIVE {GEO_SQL}
SELECT id, CASE WHEN geo_cluster = -1 THEN 0 ELSE
  count(*) OVER (PARTITION BY geo_cluster ORDER BY epoch_us(start_datetime)
                 RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) END AS events_last_7days
FROM inc JOIN geo USING (id)""")
def q_events_last_7days(spark, sf):
    """Events of the same density cluster in the previous 7 days, strict; 0 for noise (cluster −1)."""
    d = X.inc(spark, sf).select("id", "start_datetime", "latitude", "longitude")
    d = d.join(dbscan(d.select("id", "latitude", "longitude")), "id")
    out = W.trailing_count(d, "geo_cluster", "events_last_7days", valid=F.col("geo_cluster") != -1)
    return out.select("id", "events_last_7days")


@query("days_since_last", """
SELECT id, (epoch_us(start_datetime) - epoch_us(lag(start_datetime) OVER (PARTITION BY corridor ORDER BY start_datetime, id)))
  / 86400000000.0 AS days_since_last_incident
FROM inc""")
def q_days_since_last(spark, sf):
    """W09 (grain: corridor)."""
    d = X.inc(spark, sf).select("id", "start_datetime", "corridor")
    return W.days_since_last(d, "corridor", "days_since_last_incident").select("id", "days_since_last_incident")


@query("train_test_split", """
SELECT id, CASE WHEN CAST(('0x' || substr(md5('42' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 20
  THEN 'test' ELSE 'train' END AS split
FROM inc""")
def q_train_test_split(spark, sf):
    """Deterministic 80/20 split by md5 bucket."""
    return X.inc(spark, sf).select("id", W.hash_split(F.col("id")).alias("split"))
