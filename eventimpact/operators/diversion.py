"""Diversion planning (M18, M18b, M19, N04, N05, J12): closure requests ⟕ the fixed route dimension.

Requests with a known corridor take its parallel routes (left join); the rest fall to the generic plan
(anti join) — both branches are plain DataFrame plans, unioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import affected_area, haversine_km, travel_minutes
from ..sources import dims as D


def route_dim(spark) -> DataFrame:
    rows = [(c, i + 1, name, a[0], a[1], b[0], b[1])
            for c, (_, _, roads) in D.CORRIDOR_ROUTES.items() for i, (name, a, b) in enumerate(roads)]
    return spark.createDataFrame(rows, "r_corridor string, route_no int, route_name string, a_lat double, a_lon double, "
                                       "b_lat double, b_lon double")


def _length(df: DataFrame) -> DataFrame:
    return df.withColumn("length_km", haversine_km(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"),
                                                   F.col("end_lon")))


def specific_routes(requests: DataFrame, k: int = 3) -> DataFrame:
    """Up to ``k`` parallel routes per request of a mapped corridor."""
    r = F.broadcast(route_dim(requests.sparkSession))   # 6-row fixed dimension
    j = requests.join(r, (requests.corridor == r.r_corridor) & (r.route_no <= k), "inner")
    km = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return j.select("request_id", "corridor", "route_no", "route_name", km.alias("route_km"),
                    travel_minutes(km).alias("time_diff_min"),
                    F.concat(F.lit("alternate_"), F.col("route_no").cast("string")).alias("route_type"))


def generic_routes(requests: DataFrame, k: int = 3) -> DataFrame:
    """For unmapped corridors — k routes via the plain midpoint, minutes 5 + 3i, length × (1.2 + 0.1i)."""
    r = F.broadcast(route_dim(requests.sparkSession).select("r_corridor").distinct())
    g = _length(requests.join(r, requests.corridor == r.r_corridor, "left_anti"))
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return g.select("request_id", "corridor", (F.col("i") + 1).alias("route_no"),
                    F.format_string("Alternate Route %d", F.col("i") + 1).alias("route_name"),
                    (F.col("length_km") * (1.2 + F.col("i") * 0.1)).alias("route_km"),
                    (5 + F.col("i") * 3).alias("time_diff_min"),
                    ((F.col("start_lat") + F.col("end_lat")) / 2).alias("mid_lat"),
                    ((F.col("start_lon") + F.col("end_lon")) / 2).alias("mid_lon"))


def diversion_plan(requests: DataFrame, k: int = 3) -> DataFrame:
    """Per request — plan type, closure length, route count, mean delay, area, recommended route."""
    base = _length(requests)
    sp = specific_routes(requests, k).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_routes"), F.avg("time_diff_min").alias("estimated_avg_delay_min"),
        F.min_by("route_name", "route_no").alias("recommended_route"))
    gen = generic_routes(requests, k).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("g_n"), F.avg("time_diff_min").alias("g_delay"))
    j = base.join(sp, "request_id", "left").join(gen, "request_id", "left")
    specific = F.col("n_routes").isNotNull()
    return j.select(
        "request_id", F.when(specific, F.col("corridor")).otherwise(F.lit("Generic")).alias("plan_corridor"),
        "length_km", F.coalesce("n_routes", "g_n").alias("n_routes"),
        F.coalesce("estimated_avg_delay_min", "g_delay").alias("estimated_avg_delay_min"),
        F.when(specific, affected_area(2.0)).otherwise(F.lit(4.0)).alias("affected_area_km2"),
        F.coalesce("recommended_route", F.lit("Alternate Route 1")).alias("recommended_route"))


def route_geojson(routes: DataFrame) -> DataFrame:
    """Route as a GeoJSON Feature string, (lat, lon) → [lon, lat]."""
    coords = F.array(F.array(F.col("a_lon"), F.col("a_lat")), F.array(F.col("b_lon"), F.col("b_lat")))
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.col("route_name").alias("name"), F.col("route_type").alias("route_type"),
                             F.coalesce(D.literal_map(D.ROUTE_COLORS)[F.col("route_type")], F.lit("#3b82f6")).alias("color"))
                    .alias("properties"),
                    F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"))
    return routes.withColumn("geojson", F.to_json(feat))


def closure_barricades(requests: DataFrame) -> DataFrame:
    """Entry (4), exit (4), diversion junction at midpoint + 0.005° (3), pedestrian zone at midpoint − 0.005° lat (2)."""
    ml = (F.col("start_lat") + F.col("end_lat")) / 2
    mo = (F.col("start_lon") + F.col("end_lon")) / 2

    def b(pos, loc, la, lo, typ, cnt):
        return F.struct(F.lit(pos).alias("pos"), F.lit(loc).alias("location"), la.alias("latitude"),
                        lo.alias("longitude"), F.lit(typ).alias("type"), F.lit(cnt).alias("count"))

    arr = F.array(b(0, "Closure Entry Point", F.col("start_lat"), F.col("start_lon"), "full_closure", 4),
                  b(1, "Closure Exit Point", F.col("end_lat"), F.col("end_lon"), "full_closure", 4),
                  b(2, "Diversion Junction", ml + 0.005, mo + 0.005, "diversion", 3),
                  b(3, "Pedestrian Safety Zone", ml - 0.005, mo, "pedestrian_safety", 2))
    return requests.select("request_id", F.explode(arr).alias("b")).select("request_id", "b.*")
