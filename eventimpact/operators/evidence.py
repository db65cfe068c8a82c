"""Historical evidence (A34, J04, J05, M05, M06, A29): request table ⋈ one GROUPING SETS aggregate.

The history is aggregated once at three grains — (cause, tier, closure), (cause, tier), (cause) — in a single
``Expand`` + hash aggregate; requests join the three grains (equi-joins; AQE broadcasts the aggregate when it
is measured small at runtime, and keeps a shuffle join otherwise). The fallback ladder is a ``when`` over the
joined counts. Nothing is evaluated per request against the raw history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import risk_class

GRAINS = (("event_cause", "corridor_tier", "requires_road_closure"), ("event_cause", "corridor_tier"),
          ("event_cause",))


def evidence_aggregate(history: DataFrame, score: str = "impact_score") -> DataFrame:
    """One aggregate over the three grains, tagged with ``grain`` 1/2/3 (from ``grouping_id``)."""
    h = history.withColumn("__cls", risk_class(F.col(score)))
    cls = F.col("__cls")
    g = h.groupingSets([list(x) for x in GRAINS], *GRAINS[0]).agg(
        F.grouping_id().alias("__gid"),
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("avg_score"),
        F.sum(F.when(cls == "Critical", 1).otherwise(0)).cast("long").alias("n_critical"),
        F.sum(F.when(cls == "High", 1).otherwise(0)).cast("long").alias("n_high"),
        F.sum(F.when(cls == "Medium", 1).otherwise(0)).cast("long").alias("n_medium"),
        F.sum(F.when(cls == "Low", 1).otherwise(0)).cast("long").alias("n_low"))
    grain = F.when(F.col("__gid") == 0, 1).when(F.col("__gid") == 1, 2).otherwise(3)
    return g.withColumn("grain", grain).drop("__gid")


STAT_COLS = ["n", "avg_score", "n_critical", "n_high", "n_medium", "n_low"]


def grain_tables(history: DataFrame, score: str = "impact_score") -> list[DataFrame]:
    """The three ladder grains for lookups: the finest grain is aggregated once from the history (one scan,
    partial aggregation) and the two coarser grains are rolled up from that small table (≤ causes × tiers × 2
    rows) — filtering one GROUPING SETS result per grain would make Catalyst push each filter below the
    ``Expand`` and scan the history three times."""
    cls = risk_class(F.col(score))
    g1 = history.groupBy(*GRAINS[0]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(score).alias("s"),
        *[F.sum(F.when(cls == c, 1).otherwise(0)).cast("long").alias(f"n_{c.lower()}")
          for c in ("Critical", "High", "Medium", "Low")])
    sums = [F.sum(c).alias(c) for c in ("n", "s", "n_critical", "n_high", "n_medium", "n_low")]
    out = []
    for keys in GRAINS:
        g = g1 if keys == GRAINS[0] else g1.groupBy(*keys).agg(*sums)
        out.append(g.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                            F.col("n").cast("long").alias("n"), (F.col("s") / F.col("n")).alias("avg_score"),
                            *[F.col(c).cast("long").alias(c) for c in ("n_critical", "n_high", "n_medium", "n_low")]))
    return out


def evidence_lookup(requests: DataFrame, history: DataFrame, cause: str = "cause", tier: str = "tier",
                    closure: str = "closure", score: str = "impact_score") -> DataFrame:
    """Per request — rung used (1 three keys, 2 cause+tier, 3 cause only), count, critical rate %,
    mean score and class distribution; zeros when nothing matches."""
    out = requests
    req_keys = (cause, tier, closure)
    for k, (keys, g) in enumerate(zip(GRAINS, grain_tables(history, score)), start=1):
        g = g.select(*[f"__k{i}" for i in range(len(keys))], *[F.col(c).alias(f"g{k}_{c}") for c in STAT_COLS])
        cond = None
        for i, _ in enumerate(keys):
            c = F.col(req_keys[i]) == F.col(f"__k{i}")
            cond = c if cond is None else cond & c
        # no hint: the keys are data, so AQE measures the aggregate and broadcasts it only when it is small
        out = out.join(g, cond, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    n1, n2 = F.coalesce(F.col("g1_n"), F.lit(0)), F.coalesce(F.col("g2_n"), F.lit(0))
    rung = F.when(n1 >= 5, 1).when(n2 >= 3, 2).otherwise(3)
    out = out.withColumn("rung", rung)

    def pick(c):
        return (F.when(F.col("rung") == 1, F.col(f"g1_{c}")).when(F.col("rung") == 2, F.col(f"g2_{c}"))
                .otherwise(F.col(f"g3_{c}")))

    cnt = F.coalesce(pick("n"), F.lit(0)).cast("long")
    out = out.select(
        *requests.columns, "rung", cnt.alias("evidence_count"),
        F.when(cnt > 0, F.coalesce(pick("n_critical"), F.lit(0)) / cnt * 100).otherwise(F.lit(0.0)).alias("critical_rate"),
        F.when(cnt > 0, pick("avg_score")).otherwise(F.lit(0.0)).alias("average_score"),
        *[F.coalesce(pick(f"n_{c}"), F.lit(0)).cast("long").alias(f"n_{c}") for c in ("low", "medium", "high", "critical")],
        n1.cast("long").alias("matching_count"))
    # Class distribution as a map with zero defaults
    dist = F.create_map(*[x for c in ("Low", "Medium", "High", "Critical")
                          for x in (F.lit(c), F.col(f"n_{c.lower()}"))])
    return out.withColumn("score_distribution", dist)


def confidence_level(matching: str = "matching_count"):
    """≥30 High, ≥10 Medium, else Low."""
    n = F.col(matching)
    return F.when(n >= 30, "High").when(n >= 10, "Medium").otherwise("Low")


def evidence_examples(requests: DataFrame, history: DataFrame, n: int = 5, cause: str = "cause", tier: str = "tier",
                      closure: str = "closure", spread: int = 64) -> DataFrame:
    """P11 inside M06: up to ``n`` examples per request, in the order of md5(id) (T23), on the rung of its evidence.

    Each grain keeps the best ``n`` of each of ``spread`` slices of a key's rows before one window sees a key, so a hot
    key is split; at most ``n`` rows a key are joined to the requests, so no request fans out over the history."""
    from pyspark.sql import Window
    rows = history.select("id", "corridor", "hour", "impact_score", *GRAINS[0], F.md5(F.col("id").cast("string")).alias("__h"))
    req_keys, out = (cause, tier, closure), None
    for rung, keys in enumerate(GRAINS, start=1):
        some = rows
        for part in ([*keys, F.pmod(F.xxhash64("id"), F.lit(spread))], list(keys)):
            w = Window.partitionBy(*part).orderBy("__h")
            some = some.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
        some = some.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "pos", F.col("id").alias("example_id"), "corridor",
                           "hour", "impact_score", F.col("requires_road_closure").alias("example_closure"))
        on = [F.col(req_keys[i]) == F.col(f"__k{i}") for i in range(len(keys))]
        got = requests.filter(F.col("rung") == rung).join(some, on).drop(*[f"__k{i}" for i in range(len(keys))])
        out = got if out is None else out.unionByName(got)
    return out


def transit_chain(requests: DataFrame, history: DataFrame, cause: str = "cause", veh: str = "vehicle_type",
                  tier: str = "tier") -> DataFrame:
    """Breakdown ∧ (BMTC|KSRTC) ∧ tier 1 → historical case count, passengers (×60), bus type text."""
    vk = F.regexp_replace(F.lower(F.coalesce(F.col("veh_type"), F.lit(""))), " ", "_")
    hist_n = history.filter((F.col("event_cause") == "vehicle_breakdown") & vk.isin("bmtc_bus", "ksrtc_bus")
                            & (F.col("corridor_tier") == 1)).agg(F.count(F.lit(1)).alias("historical_cases"))
    rv = F.regexp_replace(F.lower(F.coalesce(F.col(veh), F.lit(""))), " ", "_")
    trig = (F.col(cause) == "vehicle_breakdown") & rv.isin("bmtc_bus", "ksrtc_bus") & (F.col(tier) == 1)
    from .stats import with_scalars
    out = with_scalars(requests, hist_n)
    return out.select(
        *requests.columns, trig.alias("triggered"),
        F.when(trig, F.col("historical_cases")).alias("historical_cases"),
        F.when(trig, F.col("historical_cases") * 60).alias("estimated_passenger_disruption"),
        F.when(trig, F.when(rv.contains("bmtc"), "BMTC").otherwise("KSRTC")).alias("bus_type"))
