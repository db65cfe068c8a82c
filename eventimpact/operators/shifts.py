"""Shift briefing (A25): a roll-up of the 168-slot risk window into Morning / Evening / Night.

Reproduces T13: slot means are rounded to one decimal before the weighted mean, and the shift top-5 lists
are sums of each slot's top-3 lists (not counts over all rows). ``exact=True`` uses unrounded slot means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.rules import round_half
from ..functions.temporal import shift_label, shift_name
from .profiles import NON_CORRIDOR, ranked_counts, risk_window


def shift_briefing(df: DataFrame, exact: bool = False) -> DataFrame:
    rw = risk_window(df).withColumn("shift", shift_name(F.col("hour")))
    ai = F.col("avg_impact") if exact else round_half(F.col("avg_impact"), 1)
    sh = rw.groupBy("shift").agg(F.sum("event_count").cast("long").alias("total_events"),
                                 F.sum("critical_count").alias("tc"),
                                 F.sum(F.when(F.col("event_count") > 0, ai * F.col("event_count")).otherwise(0)).alias("ws"))
    n = F.col("total_events")
    cr = F.when(n > 0, F.col("tc") * 100.0 / n).otherwise(F.lit(0.0))
    av = F.when(n > 0, F.col("ws") / n).otherwise(F.lit(0.0))
    if not exact:
        cr, av = round_half(cr, 1), round_half(av, 1)
    sh = sh.select(F.col("shift").alias("shift_name"), shift_label(F.col("shift")).alias("shift_hours"), "total_events",
                   cr.alias("critical_rate"), av.alias("avg_impact"))
    level = (F.when((F.col("avg_impact") >= 40) | (F.col("critical_rate") >= 10), "High")
             .when((F.col("avg_impact") >= 25) | (F.col("critical_rate") >= 5), "Elevated").otherwise("Normal"))
    return sh.withColumn("stress_level", level).select("shift_name", "shift_hours", "stress_level", "total_events",
                                                       "critical_rate", "avg_impact")


def shift_top_lists(df: DataFrame, k_slot: int = 3, k_shift: int = 5) -> DataFrame:
    c = ranked_counts(df.filter(F.col("corridor") != NON_CORRIDOR), ["weekday", "hour"], "corridor", k_slot)
    u = ranked_counts(df, ["weekday", "hour"], "event_cause", k_slot)
    top = (c.select("hour", F.lit("corridor").alias("kind"), F.col("corridor").alias("name"), "count")
           .unionByName(u.select("hour", F.lit("cause").alias("kind"), F.col("event_cause").alias("name"), "count")))
    t = (top.withColumn("shift_name", shift_name(F.col("hour"))).groupBy("shift_name", "kind", "name")
         .agg(F.sum("count").cast("long").alias("count")))
    w = Window.partitionBy("shift_name", "kind").orderBy(F.desc("count"), "name")
    return t.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k_shift)
