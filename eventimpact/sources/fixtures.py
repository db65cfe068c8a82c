"""Fixture views over the driver tables (FIXTURES.md §2), written with the DataFrame API.

The reference's own incident data are not public, so each operator runs on a view of a driver table that
carries the reference's columns: ``inc`` (incidents, from ``events``), ``scored`` (``inc`` plus the v2 impact
label), ``plan`` (planned events, from ``orders``), ``plog`` (prediction log, ``orders`` left join the
per-order ``lineitem`` mean) and ``wx`` (3 h rain items, from ``inc``). All are pure projections or one
aggregate of the scanned table, so their work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed parameters of the fixture queries (FIXTURES.md §2).
INC_NOW = "2024-01-30 12:00:00"
PLAN_NOW = "1998-06-01"
CORRIDORS = ["Non-corridor", *[f"C{i}" for i in range(7)]]


def corridor_of(key: Column) -> Column:
    m = key % 8
    return F.when(m == 7, F.lit("Non-corridor")).otherwise(F.concat(F.lit("C"), m.cast("string")))


def tier_of(key: Column) -> Column:
    m = key % 8
    return (F.when(m == 7, 0).when(m <= 1, 1).when(m <= 4, 2).otherwise(3)).cast("int")


def inc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    k, u, ts = F.col("k"), F.col("user_id"), F.col("ts")
    cause = (F.when(F.col("event_type") == "error", "accident")
             .when(F.col("event_type") == "click", "vehicle_breakdown")
             .when(F.col("event_type") == "view", "water_logging")
             .when(F.col("event_type") == "signup", "tree_fall")
             .otherwise("protest"))
    veh = (F.when(k % 5 == 0, "bmtc_bus").when(k % 5 == 1, "truck").when(k % 5 == 2, "private_car")
           .when(k % 5 == 3, "ksrtc_bus"))
    return e.select(
        F.col("event_id").alias("id"),
        ts.alias("start_datetime"),
        cause.alias("event_cause"),
        F.when(k % 10 == 0, "planned").otherwise("unplanned").alias("event_type"),
        corridor_of(u).alias("corridor"),
        tier_of(u).alias("corridor_tier"),
        F.when(u % 54 == 53, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("S"), (u % 54).cast("string"))).alias("police_station"),
        F.when(u % 10 != 9, F.concat(F.lit("J"), (u % 97).cast("string"))).alias("junction"),
        veh.alias("veh_type"),
        F.when(k < 8, 1).otherwise(0).cast("int").alias("requires_road_closure"),
        F.hour(ts).cast("int").alias("hour"),
        F.weekday(ts).cast("int").alias("weekday"),
        F.month(ts).cast("int").alias("month"),
        F.when(k >= 90, F.lit(None).cast("double")).otherwise(F.col("value") * 4).alias("duration_minutes"),
        (F.lit(12.5) + ((u * 37) % 1000) / F.lit(1000.0)).alias("latitude"),
        (F.lit(77.0) + ((u * 91) % 1000) / F.lit(1000.0)).alias("longitude"),
        k,
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.rules import impact_score_v2
    from ..functions.temporal import is_peak
    from ..operators.stats import impute_median

    df = impute_median(inc(spark, sf_dir), "duration_minutes", "dur")
    df = df.withColumn("is_peak_hour", is_peak(F.col("hour"), "code"))
    return df.withColumn("impact_score", impact_score_v2(F.col("dur"), F.col("requires_road_closure"),
                                                          F.col("corridor_tier"), F.col("is_peak_hour")))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    m6 = key % 6
    etype = (F.when(m6 == 0, "festival").when(m6 == 1, "sports").when(m6 == 2, "rally")
             .when(m6 == 3, "procession").when(m6 == 4, "public_event").otherwise("construction"))
    return o.select(
        key.alias("event_id"),
        F.concat(F.lit("event "), key.cast("string")).alias("event_name"),
        etype.alias("event_type"),
        F.col("o_orderdate").cast("date").alias("event_date"),
        (key % 24).cast("int").alias("hour"),
        F.weekday("o_orderdate").cast("int").alias("weekday"),
        F.month("o_orderdate").cast("int").alias("month"),
        corridor_of(cust).alias("corridor"),
        tier_of(cust).alias("corridor_tier"),
        F.floor(F.col("o_totalprice") / 5).cast("int").alias("expected_crowd"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("closure_required"),
    )


def plog(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    d = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
         .agg(F.avg("l_discount").alias("d")))
    key = F.col("o_orderkey")
    pred = F.lit(10) + (key * 7919 % 9000) / F.lit(100.0)
    j = o.join(d, o.o_orderkey == d.l_orderkey, "left")
    return j.select(
        key.alias("prediction_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("cause"),
        corridor_of(F.col("o_custkey")).alias("corridor"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("closure"),
        (key % 24).cast("int").alias("hour"),
        F.when(key % 50 == 0, F.lit(0.0)).otherwise(pred).alias("predicted_impact"),
        F.when((F.col("o_orderstatus") == "P") | F.col("d").isNull(), F.lit(None).cast("double"))
         .otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), pred + (F.col("d") - 0.05) * 200)))
         .alias("actual_impact"),
    )


def wx(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inc(spark, sf_dir).filter(F.col("corridor") != "Non-corridor")
    return (i.groupBy("corridor", F.col("start_datetime").cast("date").alias("day"),
                      F.floor(F.col("hour") / 3).cast("int").alias("slot"))
            .agg((F.sum("duration_minutes") / 100).alias("rain_3h_mm"),
                 (F.avg("k") / 100).alias("rain_prob")))


# The 21 tier-map corridor names in their fixed order; ``user_id % 24`` picks one (21 → a misspelt name,
# 22 → Non-corridor, 23 → NULL) so dimension joins see hits, misses and NULLs.
def corridor_name(user_id: Column) -> Column:
    from .dims import CORRIDOR_TIERS
    m = user_id % 24
    names = F.array(*[F.lit(n) for n in CORRIDOR_TIERS])
    return (F.when(m < 21, F.element_at(names, (m + 1).cast("int"))).when(m == 21, "Bannerghata Road")
            .when(m == 22, "Non-corridor"))


def closure_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversion requests: every closure incident, closed from its point to 0.01° north-east (ours)."""
    e = read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    u = F.col("user_id")
    lat = F.lit(12.5) + ((u * 37) % 1000) / F.lit(1000.0)
    lon = F.lit(77.0) + ((u * 91) % 1000) / F.lit(1000.0)
    return e.filter(F.col("k") < 8).select(
        F.col("event_id").alias("request_id"), corridor_name(u).alias("corridor"), lat.alias("start_lat"),
        lon.alias("start_lon"), (lat + 0.01).alias("end_lat"), (lon + 0.01).alias("end_lon"))
