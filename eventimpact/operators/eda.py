"""Descriptive aggregates.

Each is one hash aggregate with partial (map-side) aggregation, so the shuffle carries one row per group
per task; rankings and shares are windows over those small aggregates, never over raw rows.
"""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.dims import WEEKDAY_NAMES
from .profiles import NON_CORRIDOR, ranked_counts, with_class
from .stats import exact_quantiles, with_quantiles, with_scalars


def count_star():
    return F.count(F.lit(1))


def city_kpis(df: DataFrame, score: str = "impact_score") -> DataFrame:
    """Totals, critical and closure counts, mean impact, distinct corridors and stations (exact)."""
    d = with_class(df, score)
    return d.agg(count_star().alias("total_events"),
                 F.sum(F.when(F.col("impact_class") == "Critical", 1).otherwise(0)).cast("long").alias("critical_count"),
                 F.sum("requires_road_closure").cast("long").alias("closure_count"),
                 F.avg(score).alias("avg_impact"),
                 F.countDistinct("corridor").alias("unique_corridors"),
                 F.countDistinct("police_station").alias("unique_stations"))


def class_distribution(df: DataFrame, score: str = "impact_score") -> DataFrame:
    """A02."""
    return with_class(df, score).groupBy("impact_class").agg(count_star().alias("n"))


def top_keys(df: DataFrame, key: str, k: int, exclude_non_corridor: bool = False) -> DataFrame:
    """Top-k keys by count (count desc, key asc): at most k rows, safe to broadcast."""
    d = df.filter(F.col("corridor") != NON_CORRIDOR) if exclude_non_corridor else df
    return ranked_counts(d, [], key, k).select(key)


def closure_rate_by_cause(df: DataFrame, top: int = 12) -> DataFrame:
    """A03 + J14: closure rate % by cause, restricted (semi join) to the ``top`` commonest causes."""
    rates = df.groupBy("event_cause").agg((F.avg("requires_road_closure") * 100).alias("closure_rate"))
    return rates.join(F.broadcast(top_keys(df, "event_cause", top)), "event_cause", "left_semi")


def corridor_hour_heatmap(df: DataFrame, top: int = 10) -> DataFrame:
    """A04 + J14: (corridor, hour) counts for the ``top`` corridors (Non-corridor excluded)."""
    d = df.filter(F.col("corridor") != NON_CORRIDOR)
    counts = d.groupBy("corridor", "hour").agg(count_star().alias("n"))
    return counts.join(F.broadcast(top_keys(d, "corridor", top)), "corridor", "left_semi")


def corridor_hour_pivot(df: DataFrame, top: int = 10) -> DataFrame:
    """Corridor × 24 hours pivot, 0-filled, for the ``top`` corridors (all corridor values)."""
    d = df.join(F.broadcast(top_keys(df, "corridor", top)), "corridor", "left_semi")
    p = d.groupBy("corridor").pivot("hour", list(range(24))).agg(count_star())
    return p.select("corridor", *[F.coalesce(F.col(str(h)), F.lit(0)).cast("long").alias(f"h{h:02d}")
                                  for h in range(24)])


def risk_heatmap(df: DataFrame, score: str = "impact_score") -> DataFrame:
    """A06 + J15: corridor × 24-hour grid; empty cells take the corridor mean (0 if none)."""
    cell = df.groupBy("corridor", "hour").agg(F.avg(score).alias("cell_avg"))
    corr = df.groupBy("corridor").agg(F.avg(score).alias("corridor_avg"))
    grid = corr.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))   # corridors × 24, no join
    g = grid.join(cell, ["corridor", "hour"], "left")
    return g.select("corridor", "hour",
                    F.coalesce("cell_avg", "corridor_avg", F.lit(0.0)).alias("risk"))


def resolution_stats(df: DataFrame, col: str = "resolution_time_hours") -> DataFrame:
    """Median, mean, p90 (linear interpolation) and max."""
    q = exact_quantiles(df, col, [0.5, 0.9], names=["median", "p90"])
    return with_scalars(df.agg(F.avg(col).alias("mean"), F.max(col).alias("max")), q.drop("n")).select("median", "mean", "p90", "max")


def group_median(df: DataFrame, key: str, col: str, min_count: int, top: int) -> DataFrame:
    """Per-group median of the values there are, with HAVING count ≥ min_count, top groups by median desc."""
    g = exact_quantiles(df, col, [0.5], [key], ["median"])
    return g.filter(F.col("n") >= min_count).orderBy(F.desc("median"), key).limit(top)


def box_stats(df: DataFrame, key: str, col: str, top: int = 10) -> DataFrame:
    """Quartiles and range per group for the ``top`` commonest keys."""
    d = df.join(F.broadcast(top_keys(df, key, top)), key, "left_semi")      # at most ``top`` rows
    q = exact_quantiles(d, col, [0.25, 0.5, 0.75], [key], ["q1", "median", "q3"])
    g = d.groupBy(key).agg(F.min(col).alias("min"), F.max(col).alias("max"), F.count(col).alias("n"))
    return with_quantiles(g, q, [key]).select(key, "n", "min", "q1", "median", "q3", "max")


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation per pair in ONE aggregate (pairwise-complete: NULL pairs skipped), long form.

    Only the upper triangle is aggregated (k·(k−1)/2 correlations); the diagonal is 1 for a non-constant column
    and the lower triangle mirrors the upper one. A pair with a constant side is NULL (pandas: NaN) instead of an
    ANSI divide-by-zero error.
    """
    upper = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]

    def pair_corr(a, b):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        var = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
        return F.when(var > 0, F.corr(x, y))

    row = df.agg(*[pair_corr(a, b).alias(f"{a}__{b}") for a, b in upper],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"__sd_{c}") for c in cols])
    items = []
    for a, b in upper:
        items += [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{a}__{b}").alias("corr")),
                  F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"{a}__{b}").alias("corr"))]
    items += [F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"),
                       F.when(F.col(f"__sd_{c}") > 0, F.lit(1.0)).alias("corr")) for c in cols]
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def missing_values(df: DataFrame, top: int = 10) -> DataFrame:
    """NULL count and % per column from ONE aggregate, unpivoted; top ``top`` with count > 0."""
    cols = df.columns
    row = df.agg(count_star().alias("__n"),
                 *[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(c) for c in cols])
    long = row.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_count"))
                                                   for c in cols])).alias("s")).select("__n", "s.*")
    long = long.withColumn("missing_pct", F.col("missing_count") / F.col("__n") * 100).drop("__n")
    return long.filter(F.col("missing_count") > 0).orderBy(F.desc("missing_count"), "column_name").limit(top)


def dataset_summary(df: DataFrame, resolution: str = "resolution_time_hours") -> DataFrame:
    """A13 + A33: one-row dataset overview including geographic bounds."""
    ts = F.col("start_datetime")
    one = df.agg(
        count_star().alias("total_incidents"),
        F.min(ts).cast("date").alias("first_day"), F.max(ts).cast("date").alias("last_day"),
        F.floor((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp")))
                / F.lit(86400 * 1000000)).cast("long").alias("duration_days"),
        F.countDistinct("corridor").alias("unique_corridors"),
        F.countDistinct("police_station").alias("unique_stations"),
        F.countDistinct("event_cause").alias("event_causes"),
        F.countDistinct("veh_type").alias("vehicle_types"),
        F.sum(F.when(F.col("event_type") == "planned", 1).otherwise(0)).cast("long").alias("planned_events"),
        F.sum(F.when(F.col("event_type") == "unplanned", 1).otherwise(0)).cast("long").alias("unplanned_events"),
        F.sum("requires_road_closure").cast("long").alias("road_closures"),
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"))
    median = exact_quantiles(df, resolution, [0.5], names=["median_resolution_hours"]).drop("n")
    cols = one.columns
    return with_scalars(one, median).select(*cols[:-4], "median_resolution_hours", *cols[-4:])


def daily_trend(df: DataFrame) -> DataFrame:
    """Incidents per day, with the mean per day and the peak day (earliest on ties)."""
    d = df.groupBy(F.col("start_datetime").cast("date").alias("day")).agg(count_star().alias("n"))
    allw = Window.partitionBy()
    peak = F.max_by(F.col("day"), F.struct(F.col("n"), -F.datediff(F.col("day"), F.lit("1970-01-01")))).over(allw)
    return d.select("day", "n", F.avg("n").over(allw).alias("mean_per_day"),
                    (F.col("day") == peak).cast("int").alias("is_peak_day"))


def hourly_distribution(df: DataFrame) -> DataFrame:
    """Per-hour counts and share; rush windows 7–10 and 16–20; the peak hour (lowest hour on ties)."""
    h = df.filter(F.col("hour").isNotNull()).groupBy("hour").agg(count_star().alias("n"))
    allw = Window.partitionBy()
    tot = F.sum("n").over(allw)
    rush = (F.when(F.col("hour").between(7, 10), "morning").when(F.col("hour").between(16, 20), "evening")
            .otherwise("other"))
    peak = F.max_by(F.col("hour"), F.struct(F.col("n"), -F.col("hour"))).over(allw)
    return h.select("hour", "n", (F.col("n") / tot * 100).alias("pct"), rush.alias("rush_window"),
                    (F.col("hour") == peak).cast("int").alias("is_peak_hour"))


def weekday_distribution(df: DataFrame) -> DataFrame:
    """Per-weekday counts, busiest/quietest day, weekend share."""
    w = df.filter(F.col("weekday").isNotNull()).groupBy("weekday").agg(count_star().alias("n"))
    allw = Window.partitionBy()
    names = F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), F.col("weekday") + 1)
    busiest = F.max_by(F.col("weekday"), F.struct(F.col("n"), -F.col("weekday"))).over(allw)
    quietest = F.min_by(F.col("weekday"), F.struct(F.col("n"), F.col("weekday"))).over(allw)
    weekend = F.sum(F.when(F.col("weekday") >= 5, F.col("n")).otherwise(0)).over(allw) / F.sum("n").over(allw) * 100
    return w.select("weekday", names.alias("weekday_name"), "n",
                    (F.col("weekday") == busiest).cast("int").alias("is_busiest"),
                    (F.col("weekday") == quietest).cast("int").alias("is_quietest"), weekend.alias("weekend_pct"))


def _top(df: DataFrame, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(the ``k`` commonest keys with their rank, the one-row total of all keys): each task keeps its best ``k``."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(count_star().alias("count"))
    best = counts.orderBy(F.desc("count"), F.asc(key)).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("count"), F.asc(key)))          # over k rows
    return best.withColumn("rnk", rank), counts.agg(F.sum("count").alias("__total"))


def top_share(df: DataFrame, key: str, k_list: int = 15, k_share: int = 3) -> DataFrame:
    """Top ``k_list`` keys with counts, and the share held by the top ``k_share``."""
    best, total = _top(df, key, max(k_list, k_share))
    head = F.sum(F.when(F.col("rnk") <= k_share, F.col("count")).otherwise(0)).over(Window.partitionBy())
    out = with_scalars(best.withColumn("__head", head), total)
    return out.select(key, F.col("count").alias("n"), "rnk", F.col("__head").cast("long").alias("top_total"),
                      (F.col("__head") / F.col("__total") * 100).alias("top_pct")).filter(F.col("rnk") <= k_list)


def top_k_with_others(df: DataFrame, key: str, k: int = 8) -> DataFrame:
    """Top-k keys plus an 'Others' bucket for the rest (the total less the top k; absent when nothing is left)."""
    best, total = _top(df, key, k)
    left = with_scalars(best.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("__head")), total)
    others = left.select(F.lit("Others").alias(key), (F.col("__total") - F.col("__head")).alias("n")).filter("n > 0")
    return (best.select(key, F.col("count").alias("n")).unionAll(others).groupBy(key)
            .agg(F.sum("n").cast("long").alias("n")))


def conditional_profile(df: DataFrame, flag: str, resolution: str = "resolution_time_hours") -> DataFrame:
    """Count, closure rate %, median and mean resolution split by a flag column."""
    g = df.groupBy(flag).agg(count_star().alias("n"), (F.avg("requires_road_closure") * 100).alias("closure_rate"),
                             F.avg(resolution).alias("mean_resolution"))
    q = exact_quantiles(df, resolution, [0.5], [flag], ["median_resolution"])
    return with_quantiles(g, q, [flag]).select(flag, "n", "closure_rate", "median_resolution", "mean_resolution")


def fleet_demand(df: DataFrame, days: int = 150, top: int = 15) -> DataFrame:
    """Daily incidents n/days, tow trucks (breakdowns)/days, officers 1.5·daily; top by daily incidents."""
    d = df.filter(F.col("corridor") != NON_CORRIDOR)
    g = d.groupBy("corridor").agg(count_star().alias("n"),
                                  F.sum(F.when(F.col("event_cause") == "vehicle_breakdown", 1).otherwise(0)).alias("vb"))
    daily = F.col("n") / days
    return (g.select("corridor", (F.col("vb") / days).alias("tow_trucks_per_day"),
                     (daily * 1.5).alias("officers_per_day"), daily.alias("daily_incidents"))
            .orderBy(F.desc("daily_incidents"), "corridor").limit(top))


def density_grid(df: DataFrame, gridsize: int = 30, score: str = "impact_score") -> DataFrame:
    """A30 (squares instead of hexagons): cell counts and mean weight score/100 over the data extent."""
    d = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    m = d.agg(F.min("latitude").alias("la0"), F.max("latitude").alias("la1"),
              F.min("longitude").alias("lo0"), F.max("longitude").alias("lo1"))
    d = with_scalars(d, m)

    def cell(x, lo, hi):
        return F.when(F.col(hi) == F.col(lo), 0).otherwise(
            F.least(F.floor((F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo)) * gridsize), F.lit(gridsize - 1))).cast("int")

    d = d.withColumn("cell_y", cell("latitude", "la0", "la1")).withColumn("cell_x", cell("longitude", "lo0", "lo1"))
    return d.groupBy("cell_x", "cell_y").agg(count_star().alias("n"), F.avg(F.col(score) / 100).alias("weight"))


def hexagon_grid(df: DataFrame, gridsize: int = 30, score: str = "impact_score") -> DataFrame:
    """Counts and mean weight score/100 in hexagons, ``gridsize`` across the longitudes and gridsize/√3 up the
    latitudes of the data. A point belongs to the nearer centre of two lattices of rectangles, the second offset by half
    a side both ways (distances with latitudes stretched by √3, ties to the second). Axial coordinates ``q``, ``r``
    number the hexagons, ``r`` upwards and ``q`` along a row."""
    ny = int(gridsize / math.sqrt(3))
    d = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    m = d.agg(F.min("latitude").alias("la0"), F.max("latitude").alias("la1"), F.min("longitude").alias("lo0"), F.max("longitude").alias("lo1"))
    d = with_scalars(d, m)

    def place(x, lo, hi, n):
        return F.when(F.col(hi) == F.col(lo), 0.0).otherwise((F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo)) * n)

    d = d.withColumn("__x", place("longitude", "lo0", "lo1", gridsize)).withColumn("__y", place("latitude", "la0", "la1", ny))
    x, y, x1, y1, x2, y2 = F.col("__x"), F.col("__y"), F.rint("__x"), F.rint("__y"), F.floor("__x"), F.floor("__y")
    d1 = (x - x1) * (x - x1) + 3 * (y - y1) * (y - y1)
    d2 = (x - x2 - 0.5) * (x - x2 - 0.5) + 3 * (y - y2 - 0.5) * (y - y2 - 0.5)
    d = d.withColumn("__c", F.when(d1 < d2, 2 * x1).otherwise(2 * x2 + 1).cast("int")).withColumn("r", F.when(d1 < d2, 2 * y1).otherwise(2 * y2 + 1).cast("int"))
    g = d.groupBy("__c", "r", "la0", "la1", "lo0", "lo1").agg(count_star().alias("n"), F.avg(F.col(score) / 100).alias("weight"))
    return g.select(((F.col("__c") - F.col("r")) / 2).cast("int").alias("q"), "r",
                    (F.col("lo0") + (F.col("lo1") - F.col("lo0")) / gridsize * F.col("__c") / 2).alias("center_lon"),
                    (F.col("la0") + (F.col("la1") - F.col("la0")) / ny * F.col("r") / 2).alias("center_lat"), "n", "weight")


def slot_intensity(profile: DataFrame, count_col: str = "event_count") -> DataFrame:
    """Slot intensity = count / max count (max at least 1) with the four colour thresholds."""
    mx = F.greatest(F.max(count_col).over(Window.partitionBy()), F.lit(1))
    it = F.col(count_col) / mx
    level = (F.when(it > 0.7, 4).when(it > 0.5, 3).when(it > 0.3, 2).when(it > 0.1, 1).otherwise(0))
    return profile.select("weekday", "hour", count_col, it.alias("intensity"), level.alias("level"))


def weeks_in_data(df: DataFrame) -> DataFrame:
    """Number of weeks spanned by the data (at least 1): ceil((last day − first day + 1) / 7)."""
    return df.agg(F.greatest(F.lit(1), F.ceil((F.datediff(F.max(F.col("start_datetime").cast("date")),
                                                          F.min(F.col("start_datetime").cast("date"))) + 1) / 7))
                  .cast("long").alias("weeks"))


def slot_forecast(df: DataFrame, score: str = "impact_score") -> DataFrame:
    """A32 (contract ours): per corridor × weekday × hour — expected events per week, closure probability %,
    max observed score, commonest cause."""
    g = df.groupBy("corridor", "weekday", "hour").agg(
        count_star().alias("n"), (F.avg("requires_road_closure") * 100).alias("closure_probability"),
        F.max(score).alias("max_observed_score"))
    top = ranked_counts(df, ["corridor", "weekday", "hour"], "event_cause", 1).select(
        "corridor", "weekday", "hour", F.col("event_cause").alias("top_cause"))
    g = with_scalars(g, weeks_in_data(df))
    return (g.join(top, ["corridor", "weekday", "hour"], "left")
            .select("corridor", "weekday", "hour", (F.col("n") / F.col("weeks")).alias("expected_events"),
                    "closure_probability", "max_observed_score", "top_cause"))


def latest(df: DataFrame, n: int = 25, ts: str = "start_datetime", key: str = "id") -> DataFrame:
    """The latest ``n`` rows (TakeOrderedAndProject: a bounded top-n per task)."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def corridor_intelligence(scored: DataFrame) -> dict[str, DataFrame]:
    """The corridor-intelligence page as independent plans over one input (heatmap of the top-10 corridors,
    closure rates of the top-12 causes, cause top-8 + Others, stress leaderboard, stations, fleet demand).
    Cache ``scored`` first when all six are materialised together."""
    from .profiles import station_profile, stress_index
    return {"heatmap": corridor_hour_heatmap(scored), "closure_rates": closure_rate_by_cause(scored),
            "cause_distribution": top_k_with_others(scored, "event_cause", 8),
            "stress_leaderboard": stress_index(scored), "station_scatter": station_profile(scored),
            "fleet_demand": fleet_demand(scored)}


def city_pulse(scored: DataFrame) -> dict[str, DataFrame]:
    """KPIs, class counts, map sample (P04/P11), latest feed (O07) and stress bar."""
    from .profiles import stress_index
    m = scored.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                      & F.col("latitude").between(12.5, 13.5) & F.col("longitude").between(77.0, 78.0))
    return {"kpi": city_kpis(scored), "class_counts": class_distribution(scored),
            "map_events": m.orderBy(F.md5(F.col("id").cast("string"))).limit(500),
            "feed": latest(scored), "stress_bar": stress_index(scored)}
