"""Materialised profiles (A20–A25, A31–A34): corridor, stress, 168-slot risk window, station, shift.

Every profile is one hash aggregate with map-side partial aggregation; the group count is bounded by the
dimension (corridors, stations, 168 slots), so the windows that rank or normalise run over small aggregates.
Modes and top-k lists are computed from (group, key, count) aggregates, never by collecting rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.rules import risk_class
from ..sources.dims import WEEKDAY_NAMES

NON_CORRIDOR = "Non-corridor"


def with_class(df: DataFrame, score: str = "impact_score", out: str = "impact_class") -> DataFrame:
    return df.withColumn(out, risk_class(F.col(score)))


def ranked_counts(df: DataFrame, group: list[str], key: str, k: int | None = None,
                  rank_col: str = "rnk", count_col: str = "count") -> DataFrame:
    """(group…, key, count, rank) with ties broken count desc, key asc (T21); NULL keys dropped.

    The window partitions the *aggregate* (one row per group × key), so even a hot group is one row per key.
    """
    agg = (df.filter(F.col(key).isNotNull()).groupBy(*group, key)
           .agg(F.count(F.lit(1)).alias(count_col)))
    w = Window.partitionBy(*group).orderBy(F.col(count_col).desc(), F.col(key).asc())
    out = agg.withColumn(rank_col, F.row_number().over(w))
    return out.filter(F.col(rank_col) <= k) if k else out


def mode_of(df: DataFrame, group: list[str], key: str, out: str) -> DataFrame:
    """Commonest value per group (count desc, value asc)."""
    return (ranked_counts(df, group, key, 1).select(*group, F.col(key).alias(out)))


def top_k_array(df: DataFrame, group: list[str], key: str, k: int, name: str) -> DataFrame:
    """Top-k ``array<struct<name, count>>`` per group, collected only after the top-k filter."""
    r = ranked_counts(df, group, key, k)
    arr = F.transform(F.array_sort(F.collect_list(F.struct("rnk", F.col(key).alias(name), "count"))),
                      lambda s: F.struct(s[name].alias(name), s["count"].alias("count")))
    return r.groupBy(*group).agg(arr.alias(f"top_{name}s" if not name.endswith("s") else f"top_{name}"))


def stress_index(df: DataFrame, score: str = "impact_score", closure: str = "requires_road_closure") -> DataFrame:
    """(0.4·n/max n + 0.4·avg/max avg + 0.2·closure/max closure)·100 over corridors (Non-corridor out)."""
    g = (df.filter(F.col("corridor") != NON_CORRIDOR).groupBy("corridor")
         .agg(F.count(F.lit(1)).alias("frequency"), F.avg(score).alias("avg_impact"),
              F.avg(closure).alias("closure_share")))
    allw = Window.partitionBy()
    mf, mi, mc = (F.max(c).over(allw) for c in ("frequency", "avg_impact", "closure_share"))

    def norm(c, m):
        return F.when(m > 0, F.col(c) / m).otherwise(F.lit(0.0))

    stress = (0.4 * norm("frequency", mf) + 0.4 * norm("avg_impact", mi) + 0.2 * norm("closure_share", mc)) * 100
    return g.select("corridor", stress.alias("stress_index"), "frequency", "avg_impact",
                    (F.col("closure_share") * 100).alias("closure_rate"))


def corridor_profile(df: DataFrame, tiers: DataFrame | None = None, default_tier: int = 3,
                     score: str = "impact_score") -> DataFrame:
    """Per corridor tier, totals, closure rate %, critical count and rate %, dominant cause,
    peak hour, commonest station, mean impact and stress index (0 when absent)."""
    d = with_class(df.filter(F.col("corridor") != NON_CORRIDOR), score)
    base = d.groupBy("corridor").agg(
        F.count(F.lit(1)).alias("total_incidents"),
        (F.avg("requires_road_closure") * 100).alias("closure_rate"),
        F.sum(F.when(F.col("impact_class") == "Critical", 1).otherwise(0)).cast("long").alias("critical_count"),
        F.avg(score).alias("avg_impact"))
    base = base.withColumn("critical_rate", F.col("critical_count") / F.col("total_incidents") * 100)
    cause = mode_of(d, ["corridor"], "event_cause", "dominant_cause")
    hour = mode_of(d, ["corridor"], "hour", "peak_hour")
    station = mode_of(d, ["corridor"], "police_station", "station")
    st = stress_index(df, score).select("corridor", "stress_index")
    out = (base.join(cause, "corridor", "left").join(hour, "corridor", "left")
           .join(station, "corridor", "left").join(st, "corridor", "left"))
    if tiers is not None:
        out = out.join(F.broadcast(tiers.select("corridor", F.col("tier").alias("__t"))), "corridor", "left")
        tier = F.coalesce(F.col("__t"), F.lit(default_tier))
    else:  # tier carried on the fact rows: fold it into the base aggregate instead of a second pass
        out = out.join(d.groupBy("corridor").agg(F.max("corridor_tier").alias("__t")), "corridor", "left")
        tier = F.coalesce(F.col("__t"), F.lit(default_tier))
    return out.select(
        "corridor", tier.cast("int").alias("tier"), "total_incidents", "closure_rate", "critical_rate",
        "critical_count", F.coalesce("dominant_cause", F.lit("unknown")).alias("dominant_cause"),
        F.coalesce("peak_hour", F.lit(10)).alias("peak_hour"),
        F.coalesce("station", F.lit("Unknown")).alias("station"), "avg_impact",
        F.coalesce("stress_index", F.lit(0.0)).alias("stress_index"))


def slot_filter(df: DataFrame, weekday: int | None = None, hour: int | None = None) -> DataFrame:
    """Slots of a weekday, of an hour, of both, or all."""
    for c, v in (("weekday", weekday), ("hour", hour)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df


def slot_grid(spark) -> DataFrame:
    """The full 7×24 grid (168 rows) — a constant-size dimension."""
    return (spark.range(7).select(F.col("id").cast("int").alias("weekday"))
            .select("weekday", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")))


def risk_window(df: DataFrame, score: str = "impact_score") -> DataFrame:
    """168 slots — count, critical count/rate, mean impact, weekday name; empty slots are zeros."""
    d = with_class(df, score)
    agg = d.groupBy("weekday", "hour").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.when(F.col("impact_class") == "Critical", 1).otherwise(0)).cast("long").alias("critical_count"),
        F.avg(score).alias("avg_impact"))
    grid = slot_grid(df.sparkSession)
    names = F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), F.col("weekday") + 1)
    out = grid.join(agg, ["weekday", "hour"], "left")
    n = F.coalesce(F.col("event_count"), F.lit(0)).cast("long")
    cc = F.coalesce(F.col("critical_count"), F.lit(0)).cast("long")
    return out.select(
        "weekday", names.alias("weekday_name"), "hour", n.alias("event_count"),
        F.when(n > 0, cc / n * 100).otherwise(F.lit(0.0)).alias("critical_rate"), cc.alias("critical_count"),
        F.coalesce(F.col("avg_impact"), F.lit(0.0)).alias("avg_impact"))


def station_profile(df: DataFrame, score: str = "impact_score") -> DataFrame:
    """Per police station (NULL/blank stations dropped)."""
    d = with_class(df.filter(F.col("police_station").isNotNull() & (F.trim("police_station") != "")), score)
    return d.groupBy(F.col("police_station").alias("station")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.when(F.col("impact_class") == "Critical", 1).otherwise(0)).cast("long").alias("critical_count"),
        (F.sum(F.when(F.col("impact_class") == "Critical", 1).otherwise(0)) / F.count(F.lit(1)) * 100).alias("critical_rate"),
        F.avg(score).alias("avg_impact"),
        (F.avg("requires_road_closure") * 100).alias("closure_rate"))
