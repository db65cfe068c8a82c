"""Planned-event forecast, briefing, high-risk periods and conflicts.

All events are scored in one pass. History is aggregated once to (corridor, hour) and events look up five
hour offsets (±2, no wrap at midnight — T14) against that aggregate: an equi-join on a small table instead of
re-scanning the history per event. Conflicts aggregate per date; the adjacent-hour rule works on the sorted
distinct hours of a date (at most 24), so no window has to hold a whole day's events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import clip, crowd_tier, hash_poisson, hash_uniform, risk_class
from ..functions.temporal import is_night
from ..sources import dims as D
from .scoring import operational_baseline
from .stats import with_scalars

NON_CORRIDOR = "Non-corridor"


def event_features(events: DataFrame, history: DataFrame) -> DataFrame:
    """17-column event feature table; corridor history count defaults to 100 when 0."""
    cnt = history.groupBy("corridor").agg(F.count(F.lit(1)).alias("__hc"))
    e = events.join(cnt, "corridor", "left")
    hc = F.coalesce(F.col("__hc"), F.lit(0))
    return e.select(
        "event_id", F.coalesce(D.literal_map(D.EVENT_TYPE_ENCODING)[F.col("event_type")], F.lit(4)).alias("event_type_encoded"),
        "corridor_tier", F.when(F.col("corridor_tier") > 0, 1).otherwise(0).alias("is_corridor"),
        "hour", "weekday", "month", F.when(F.col("weekday").isin(5, 6), 1).otherwise(0).alias("is_weekend"),
        is_night(F.col("hour"), "set").alias("is_night"), "expected_crowd",
        F.log1p(F.col("expected_crowd")).alias("crowd_log"), crowd_tier(F.col("expected_crowd")).alias("crowd_tier"),
        F.when(F.col("closure_required") == 1, 1).otherwise(0).alias("closure_required"),
        F.when(hc > 0, hc).otherwise(F.lit(100)).cast("long").alias("corridor_event_count"))


def event_score(events: DataFrame) -> DataFrame:
    """Rule score standing in for the absent forecast model (ours): M03 baseline with the event type as cause,
    plus 5 points per crowd tier, clipped to 0–100."""
    base, _ = operational_baseline(F.col("event_type"), F.col("corridor_tier"), F.col("closure_required"), F.col("hour"))
    s = clip(base + 5 * crowd_tier(F.col("expected_crowd")), 0, 100).cast("double")
    return events.withColumn("predicted_impact_score", s).withColumn(
        "predicted_risk_class", risk_class(F.col("predicted_impact_score")))


def similar_history(events: DataFrame, history: DataFrame, resolution: str = "resolution_time_hours") -> DataFrame:
    """Planned history; same corridor if it has any (not for Non-corridor); then hour ± 2 if non-empty."""
    h = history.filter(F.col("event_type") == "planned")
    stats = [F.count(F.lit(1)).alias("n"), F.sum(resolution).alias("rs"), F.count(resolution).alias("rn"),
             F.sum("requires_road_closure").alias("cs")]
    ch = h.groupBy("corridor", "hour").agg(*stats)
    hh = h.groupBy("hour").agg(*stats)
    cc = h.groupBy("corridor").agg(*stats)
    al = h.agg(*stats)
    names = ["n", "rs", "rn", "cs"]

    def near(df, keys, prefix):
        # the ±2 h sums are built on the aggregate (a few rows per corridor and hour), so events look up one row
        f = df.withColumn("hour", F.explode(F.sequence(F.col("hour") - 2, F.col("hour") + 2)))
        return f.groupBy(*keys).agg(*[F.sum(c).alias(prefix + c) for c in names])

    e = events.select("event_id", "corridor", "hour")
    out = (e.join(near(ch, ["corridor", "hour"], "wc_"), ["corridor", "hour"], "left")
           .join(near(hh, ["hour"], "wa_"), "hour", "left")
           .join(cc.select("corridor", *[F.col(c).alias("cc_" + c) for c in names]), "corridor", "left"))
    from .stats import with_scalars
    out = with_scalars(out, al.select(*[F.col(c).alias("al_" + c) for c in names]))
    use_c = (F.col("corridor") != NON_CORRIDOR) & (F.coalesce(F.col("cc_n"), F.lit(0)) > 0)

    def pick(c):
        return (F.when(use_c, F.when(F.coalesce(F.col("wc_n"), F.lit(0)) > 0, F.col("wc_" + c)).otherwise(F.col("cc_" + c)))
                .otherwise(F.when(F.coalesce(F.col("wa_n"), F.lit(0)) > 0, F.col("wa_" + c)).otherwise(F.col("al_" + c))))

    n = F.coalesce(pick("n"), F.lit(0)).cast("long")
    return out.select(
        "event_id", n.alias("similar_count"),
        F.when(pick("rn") > 0, pick("rs") / pick("rn")).alias("avg_resolution_hours"),
        F.when(n > 0, pick("cs") / n * 100).alias("closure_rate"),
        F.when(n >= 10, "High").when(n >= 5, "Medium").otherwise("Low").alias("confidence_level"))


def event_forecast(events: DataFrame, history: DataFrame) -> DataFrame:
    """Score, class, confidence and similar-history summary for every event."""
    return event_score(events).join(similar_history(events, history), "event_id")


def proactive_plan(forecast: DataFrame) -> DataFrame:
    """Ordered action list per event (class template + crowd > 50 000 + closure) as rows."""
    tmpl = F.create_map(*[x for k, v in D.PLAN_ACTIONS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    crowd = F.when(F.col("expected_crowd") > 50000,
                   F.array(F.format_string("Large crowd (%s) - Deploy crowd control barriers",
                                           F.format_number(F.col("expected_crowd"), 0)))).otherwise(F.array())
    closure = F.when(F.col("closure_required") == 1,
                     F.array(F.lit("Road closure planned - Activate diversion routes in advance"))).otherwise(F.array())
    acts = F.concat(tmpl[F.col("predicted_risk_class")], crowd, closure)
    out = forecast.select("event_id", F.col("predicted_risk_class").isin("High", "Critical").alias("pre_deployment_required"),
                          F.posexplode(acts).alias("seq", "action"))
    return out


def proactive_timeline(forecast: DataFrame) -> DataFrame:
    """Timeline steps per event (time, action, resources; NULL where a step needs none of a kind)."""
    def step(t, a, r):
        return F.struct(F.lit(t).alias("time"), F.lit(a).alias("action"),
                        *[F.lit(r.get(k)).cast("int").alias(k) for k in D.PLAN_RESOURCES])

    table = F.create_map(*[x for k, v in D.PLAN_TIMELINE.items() for x in (F.lit(k), F.array(*[step(*s) for s in v]))])
    out = forecast.select("event_id", F.posexplode(table[F.col("predicted_risk_class")]).alias("seq", "s"))
    return out.select("event_id", "seq", "s.*")


def upcoming(forecast: DataFrame, now: str, days: int) -> DataFrame:
    """Events with ``now <= datetime <= now + days`` (inclusive)."""
    ts = F.col("event_datetime")
    lo = F.lit(now).cast("timestamp")
    return forecast.filter((ts >= lo) & (ts <= lo + F.make_interval(days=F.lit(days))))


def event_briefing(forecast: DataFrame) -> DataFrame:
    """One briefing row per date (all dates in one aggregate)."""
    hr = F.col("predicted_risk_class").isin("High", "Critical")
    g = forecast.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.array_join(F.array_sort(F.collect_set("corridor")), ", ").alias("corridors_affected"),
        F.sum("expected_crowd").cast("long").alias("total_expected_crowd"),
        F.sum("closure_required").cast("long").alias("closures_planned"),
        F.sum(F.when(hr, 1).otherwise(0)).cast("long").alias("high_risk_count"))
    summary = F.when(F.col("high_risk_count") > 0, F.format_string("%d high-risk events require proactive deployment",
                                                                   F.col("high_risk_count"))).otherwise(
        F.lit("Standard monitoring recommended"))
    return g.withColumn("briefing_summary", summary)


def briefing_events(forecast: DataFrame) -> DataFrame:
    """The High and Critical events of each day's briefing, one row each (a day's list is not bounded)."""
    return forecast.filter(F.col("predicted_risk_class").isin("High", "Critical"))


def high_risk_events(forecast: DataFrame, now: str, days: int = 30, corridor: str | None = None) -> DataFrame:
    """The High/Critical events of the next ``days`` days (optionally one corridor), one row each."""
    f = upcoming(forecast, now, days).filter(F.col("predicted_risk_class").isin("High", "Critical"))
    return f.filter(F.col("corridor") == corridor) if corridor else f


def high_risk_periods(forecast: DataFrame, now: str, days: int = 30, corridor: str | None = None) -> DataFrame:
    """Per date — event count and max score, sorted desc. The period's events stay a long-form table
    (``high_risk_events``): a date's event list is not bounded, so it is never collected into one row."""
    f = high_risk_events(forecast, now, days, corridor)
    return f.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("event_count"), F.max("predicted_impact_score").alias("max_risk_score"))


CONFLICT_RULES = [  # (type, severity points, severity name)
    ("Same Corridor Conflict", 3, "Critical"), ("Multiple High-Risk Events", 2, "High"),
    ("Multiple Road Closures", 3, "Critical"), ("Excessive Crowd Accumulation", 2, "High"),
    ("Time Proximity Conflict", 1, "Medium"),
]


def conflict_texts(high_risk, closures, crowd) -> list[tuple]:
    """(description, recommendation) of each rule, in the order of CONFLICT_RULES."""
    return [
        (F.lit("Multiple events on the same corridor will cause severe congestion"),
         F.lit("Reschedule one event or prepare extensive diversion routes")),
        (F.format_string("%d high-risk events on same day will strain resources", high_risk),
         F.format_string("Pre-position %d additional officers and %d barricades", high_risk * 15, high_risk * 25)),
        (F.format_string("%d road closures will significantly disrupt city traffic", closures),
         F.lit("Coordinate closure timings to avoid overlap if possible")),
        (F.format_string("Total %s people expected across events", F.format_number(crowd, 0)),
         F.lit("Deploy crowd control units and setup emergency medical facilities")),
        (F.lit("Events occurring within 2 hours of each other"),
         F.lit("Ensure rapid resource redeployment between events")),
    ]


def resampled_training_set(history: DataFrame, target: int = 1000, max_crowd: int = 80_000, id_col: str = "id") -> DataFrame:
    """About ``target`` synthetic planned events drawn from ``history`` with replacement, in one pass.

    A row is drawn a Poisson number of times of mean target / n (the Poisson bootstrap), so no task needs to know what
    others have drawn; a mean above 1 is split over replicates of at most 1. Draws depend on (replicate, id) alone. Each
    draw gets a crowd of its own, which lengthens its resolution by ``crowd_factor`` = 1 + crowd / 100,000 and raises its
    impact label by 5 points a crowd tier, to at most 100.
    """
    n = history.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("__n"))
    d = with_scalars(history.filter(F.col(id_col).isNotNull()), n)
    reps = F.greatest(F.lit(1), F.ceil(F.lit(float(target)) / F.col("__n")).cast("int"))
    d = d.withColumn("__r", reps).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.col("__r") - 1)))
    rate = F.lit(float(target)) / F.col("__n") / F.col("__r")
    key = F.concat_ws("/", F.col("replicate").cast("string"), F.col(id_col).cast("string"))
    d = d.withColumn("__w", hash_poisson(key, "draw", rate)).filter("__w > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__w"))))
    crowd = F.floor(hash_uniform(F.concat_ws("/", key, F.col("copy").cast("string")), "crowd") * max_crowd).cast("int")
    d = d.withColumn("expected_crowd", crowd).withColumn("crowd_tier", crowd_tier(F.col("expected_crowd")))
    factor = 1 + F.col("expected_crowd") / 100_000
    return d.select(id_col, "replicate", "copy", "expected_crowd", "crowd_tier", factor.alias("crowd_factor"),
                    (F.col("dur") * factor).alias("resolution_minutes"),
                    F.least(F.lit(100.0), F.col("impact_score") + 5 * F.col("crowd_tier")).alias("target"))


def event_neighbours(events: DataFrame, hours: int = 2, keys: tuple[str, ...] = ("event_date", "corridor")) -> DataFrame:
    """J10 / W08 per event: ``n_same`` others of its date and corridor, ``n_near`` of those at most ``hours`` hours apart,
    the nearest of them (``nearest_id``; ties: smaller id) and its ``gap_hours``.

    No pair of events is made. Events are counted per (date, corridor, hour), a cell that keeps its two smallest ids, and
    each cell looks into its own and the 2·``hours`` cells around it; a day has 24. The event itself is taken off its
    cell's count, and the second id stands in where it is the first. A hot date is a partial aggregate per task and one
    skewed side of the join back to the events. A null date, corridor or hour has no others; ids are unique.
    """
    keys = list(keys)
    known = events.filter(F.expr(" and ".join(f"{k} is not null" for k in [*keys, "hour"])))
    first = known.groupBy(*keys, "hour").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("id1"))
    second = known.join(first.select(*keys, "hour", "id1"), [*keys, "hour"]).filter("event_id <> id1").groupBy(*keys, "hour").agg(
        F.min("event_id").alias("id2"))
    cells = first.join(second, [*keys, "hour"], "left")
    day = first.groupBy(*keys).agg(F.sum("n").alias("n_day"))
    gaps = F.explode(F.array(*[F.lit(d) for d in range(-hours, hours + 1)])).alias("gap")
    around = cells.select(*keys, F.col("hour").alias("at"), "n", "id1", "id2", gaps).withColumn("hour", F.col("at") + F.col("gap"))
    far = F.abs("gap")
    seen = around.groupBy(*keys, "hour").agg(
        F.sum("n").alias("__n"), F.max(F.when(F.col("gap") == 0, F.col("id1"))).alias("__own1"), F.max(F.when(F.col("gap") == 0, F.col("id2"))).alias("__own2"),
        F.min(F.when(F.col("gap") != 0, F.struct(far.alias("gap"), F.col("id1").alias("id")))).alias("__other"))
    seen = seen.filter("__own1 is not null").join(day, keys)
    e = events.join(seen, [*keys, "hour"], "left")
    same = F.when(F.col("event_id") == F.col("__own1"), F.col("__own2")).otherwise(F.col("__own1"))
    best = F.coalesce(F.when(same.isNotNull(), F.struct(F.lit(0).alias("gap"), same.alias("id"))), F.col("__other"))
    e = e.withColumn("__best", best)
    return e.select(*events.columns, (F.coalesce("n_day", F.lit(1)) - 1).alias("n_same"), (F.coalesce("__n", F.lit(1)) - 1).alias("n_near"),
                    F.col("__best.id").alias("nearest_id"), F.col("__best.gap").alias("gap_hours"))


def event_conflicts(forecast: DataFrame) -> DataFrame:
    """Per date with more than one event — the five rules, severity sum and overall level."""
    hr = F.col("predicted_risk_class").isin("High", "Critical")
    g = forecast.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("event_count"), F.countDistinct("corridor").alias("__dc"),
        F.sum(F.when(hr, 1).otherwise(0)).alias("__hr"), F.sum("closure_required").alias("__cl"),
        F.sum("expected_crowd").cast("long").alias("total_expected_crowd"),
        F.array_sort(F.collect_set("hour")).alias("__hours"), F.countDistinct("hour").alias("__dh"))
    g = g.filter(F.col("event_count") > 1)
    hours = F.col("__hours")
    near = (F.col("event_count") > F.col("__dh")) | F.exists(
        F.sequence(F.lit(1), F.greatest(F.size(hours) - 1, F.lit(1))),
        lambda i: (F.size(hours) > 1) & (F.element_at(hours, i + 1) - F.element_at(hours, i) <= 2))
    fired = [F.col("event_count") != F.col("__dc"), F.col("__hr") >= 2, F.col("__cl") >= 2,
             F.col("total_expected_crowd") > 100000, near]
    texts = conflict_texts(F.col("__hr"), F.col("__cl"), F.col("total_expected_crowd"))
    rules = F.array(*[F.when(c, F.struct(F.lit(i).alias("pos"), F.lit(t).alias("type"), F.lit(p).alias("points"),
                                         F.lit(s).alias("severity"), d.alias("description"), r.alias("recommendation")))
                      for i, (c, (t, p, s), (d, r)) in enumerate(zip(fired, CONFLICT_RULES, texts))])
    g = g.withColumn("rules", F.filter(rules, lambda x: x.isNotNull()))
    score = F.aggregate(F.col("rules"), F.lit(0), lambda a, x: a + x["points"])
    g = g.withColumn("conflict_severity_score", score)
    s = F.col("conflict_severity_score")
    overall = F.when(s >= 6, "Critical").when(s >= 3, "High").when(s >= 1, "Medium").otherwise("Low")
    return g.select("event_date", "event_count", "total_expected_crowd", "rules", "conflict_severity_score",
                    overall.alias("overall_severity"))
