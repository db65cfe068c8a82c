"""Request scoring and planning rules (M03, M04, M08, M09, M10, G06): Column expressions over a request table.

A "request" is any row with cause / tier / closure / hour (/ weekday / vehicle): one request and all
incidents of a day run the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import cause_severity, clip, risk_class, round_half
from ..functions.text import title_cause
from ..sources import dims as D


def operational_baseline(cause: Column, tier: Column, closure: Column, hour: Column) -> tuple[Column, Column]:
    """35·closure + tier {1:30, 2:20, 3:10} + severity (default 5) + 5 rush (7–10, 16–20) − 5 night
    (≥22 or ≤5), clipped to 0–100; plus the component list text ``factor:delta; …``."""
    tier_pts = D.literal_map(D.BASELINE_TIER_POINTS)[tier]
    tier_pts = F.coalesce(tier_pts, F.lit(0))
    sev = cause_severity(cause)
    rush = hour.between(7, 10) | hour.between(16, 20)
    night = (hour >= 22) | (hour <= 5)
    closed = closure == 1
    score = (F.when(closed, 35).otherwise(0) + tier_pts + sev + F.when(rush, 5).otherwise(0)
             - F.when(night, 5).otherwise(0))
    comps = F.concat_ws(
        "; ",
        F.when(closed, F.lit("Road Closure:+35")),
        F.when(tier_pts > 0, F.format_string("Tier %d Corridor:+%d", tier, tier_pts)),
        F.format_string("Cause Severity (%s):+%d", cause, sev),
        F.when(rush, F.lit("Rush Hour:+5")),
        F.when(night, F.lit("Night Hours:-5")))
    return clip(score, 0, 100), comps


def blend_score(model_score: Column, evidence_count: Column, hist_avg: Column, closure: Column, tier: Column,
                cause: Column, hour: Column, floor: Column | None = None) -> Column:
    """Blend with the evidence mean (n > 10: 0.4/0.6; n > 5: 0.5/0.5; else model), rule adjustments,
    optional per-request floor from an override-rules table (empty by default), clip 0–100."""
    h = round_half(hist_avg, 1)   # the reference blends with the 1-decimal evidence mean
    b = (F.when(evidence_count > 10, model_score * 0.4 + h * 0.6)
         .when(evidence_count > 5, model_score * 0.5 + h * 0.5).otherwise(model_score))
    b = (b + F.when(closure == 1, 15).otherwise(0) + F.when(tier == 1, 10).when(tier == 2, 5).otherwise(0)
         + F.when(cause.isin("protest", "water_logging"), 10).when(cause == "tree_fall", 5).otherwise(0)
         - F.when((hour >= 22) | (hour <= 5), 8).otherwise(0))
    if floor is not None:
        b = F.when(floor.isNotNull(), F.greatest(b, floor)).otherwise(b)
    return clip(b.cast("double"), 0.0, 100.0)


# (police, barricades, crew, tow, diversion, resolution median, resolution range) of the one template in ``dims``.
RESOURCE_TEMPLATES = {
    k: (*[v["resources"][c] for c in ("police", "barricades", "crew", "tow", "diversion")], *v["resolution"])
    for k, v in D.RESOURCE_TEMPLATES.items()}

# Multiplier text "{risk × tier:.1f}x" for every (class, tier) pair, formatted once here so the half-even
# formatting of the reference is exact (16 fixed entries, derived from the two multiplier tables).
MULTIPLIER_TEXT = {f"{r}|{t}": f"{rm * tm:.1f}x" for r, rm in D.RISK_MULTIPLIER.items()
                   for t, tm in D.TIER_MULTIPLIER.items()}

TEMPLATE_SCHEMA = ("t_cause string, t_police int, t_barricades int, t_crew string, t_tow int, t_diversion boolean, "
                   "t_res_median string, t_res_range string")


def resource_dim(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RESOURCE_TEMPLATES.items()], TEMPLATE_SCHEMA)


def with_template(requests: DataFrame, cause: str = "cause") -> DataFrame:
    """Template by cause, else the 'others' row. The 14-row fixed dimension is folded into literal maps
    (no join at all); ``resource_dim`` is the same table as a DataFrame."""
    names = [c for c in resource_dim_columns()[1:]]
    out = requests
    for i, n in enumerate(names):
        m = D.literal_map({k: v[i] for k, v in RESOURCE_TEMPLATES.items()})
        out = out.withColumn(n, F.coalesce(m[F.col(cause)], F.lit(RESOURCE_TEMPLATES["others"][i])))
    return out


def resource_dim_columns() -> list[str]:
    return [c.split()[0] for c in TEMPLATE_SCHEMA.split(", ")]


def resource_scaling(requests: DataFrame, cause: str = "cause", risk: str = "risk_class", tier: str = "tier",
                     veh: str = "vehicle_type") -> DataFrame:
    """Base × risk multiplier × tier multiplier, half-even rounding (T20), ≥ 0; diversion forced for
    Critical/High on a corridor; vehicle note; resolution; multiplier text."""
    j = with_template(requests, cause)
    rm = F.coalesce(D.literal_map(D.RISK_MULTIPLIER)[F.col(risk)], F.lit(1.0))
    tm = F.coalesce(D.literal_map(D.TIER_MULTIPLIER)[F.col(tier)], F.lit(1.0))
    j = j.withColumn("__m", rm * tm)

    def scaled(c):
        return F.greatest(F.lit(0), F.bround(F.col(c) * F.col("__m"), 0).cast("int"))

    vkey = F.coalesce(D.literal_map(D.VEH_DISPLAY_MAP)[F.col(veh)], F.col(veh))
    risk_text = F.format_string("%s (%sx)", F.col(risk), rm.cast("string"))
    tier_text = F.when(F.col(tier) > 0, F.format_string("Tier %d (%sx)", F.col(tier), tm.cast("string"))).otherwise("Non-corridor (1.0x)")
    return j.select(
        *requests.columns,
        scaled("t_police").alias("police_units"), scaled("t_tow").alias("tow_trucks"),
        scaled("t_barricades").alias("barricades"), F.col("t_crew").alias("special_team"),
        (F.col("t_diversion") | (F.col(risk).isin("Critical", "High") & (F.col(tier) >= 1))).alias("diversion_required"),
        F.coalesce(D.literal_map(D.VEH_NOTES)[vkey], F.lit("")).alias("vehicle_note"),
        F.col("t_res_median").alias("resolution_median"), F.col("t_res_range").alias("resolution_range"),
        risk_text.alias("risk_multiplier"), tier_text.alias("tier_multiplier"),
        D.literal_map(MULTIPLIER_TEXT)[F.concat_ws("|", F.col(risk), F.col(tier).cast("string"))]
        .alias("total_multiplier"))


def barricade_placement(requests: DataFrame, total: str = "barricades", tier: str = "tier", cause: str = "cause",
                        risk: str = "risk_class", lat: str | None = None, lon: str | None = None) -> DataFrame:
    """Up to three placements per request as rows; a request without barricades is one row that says so
    (no placement, nothing to set up). ``gps_verified`` tells whether the request carries a location."""
    n, t = F.col(total), F.col(tier)
    la = F.col(lat) if lat else F.lit(D.DEFAULT_POINT[0])
    lo = F.col(lon) if lon else F.lit(D.DEFAULT_POINT[1])
    primary = F.greatest(F.lit(2), F.bround(n * 0.4, 0).cast("int"))
    rem1 = n - primary
    div_on = (t >= 1) & (rem1 >= 2)
    div = F.when(div_on, F.greatest(F.lit(2), F.bround(rem1 * 0.5, 0).cast("int")))
    rem2 = rem1 - F.coalesce(div, F.lit(0))
    ped = F.col(cause).isin("tree_fall", "water_logging", "protest")

    def place(prio, ltype, plat, plon, cnt, ptype, reason, when, metres):
        return F.struct(F.lit(prio).alias("priority"), ltype.alias("location_type"), plat.alias("latitude"),
                        plon.alias("longitude"), cnt.cast("int").alias("count"), ptype.alias("type"),
                        reason.alias("reason"), F.lit(when).alias("deployment_time"),
                        metres.cast("int").alias("distance_from_incident_m"))

    p1 = place(1, F.lit("Incident Site - Entry Block"), la, lo, primary,
               F.when(F.col(risk).isin("Critical", "High"), "full_closure").otherwise("partial_closure"),
               F.lit("Block vehicle entry to incident site"), "T-0 (immediate)", F.lit(None))
    p2 = F.when(div_on, place(2, F.lit("Upstream Junction - Diversion"), la + 0.0045, lo, div, F.lit("diversion_signage"),
                               F.lit("Redirect traffic to alternate route 500m before incident"), "T-0 to T+5min", F.lit(500)))
    p3 = F.when(rem2 >= 2, place(3, F.when(ped, "Pedestrian Safety Zone").otherwise("Downstream Exit Block"),
                                 F.when(ped, la).otherwise(la - 0.0027), F.when(ped, lo + 0.0018).otherwise(lo),
                                 rem2, F.when(ped, "pedestrian_safety").otherwise("exit_control"),
                                 F.when(ped, "Protect pedestrian movement near incident").otherwise(
                                     "Prevent vehicles from exiting blocked segment"),
                                 "T+5min to T+10min", F.when(ped, 200).otherwise(300)))
    arr = F.when(n > 0, F.filter(F.array(p1, p2, p3), lambda x: x.isNotNull()))
    strategy = (F.when(n == 0, "No barricades required").when(F.col(risk) == "Critical", "Immediate full closure with police escort for barricade deployment")
                .when(F.col(risk) == "High", "Phased deployment: Site blocking first, then diversion points")
                .otherwise("Standard deployment: Sequential placement based on priority"))
    new = ("priority", "location_type", "latitude", "longitude", "count", "type", "reason", "deployment_time", "distance_from_incident_m")
    keep = [c for c in requests.columns if c not in new]
    known = (F.col(lat).isNotNull() & F.col(lon).isNotNull()) if lat and lon else F.lit(False)
    out = requests.select(*keep, F.explode_outer(arr).alias("p"), F.when(n > 0, known).alias("gps_verified"),
                          (n * 2).alias("setup_time_min"), strategy.alias("deployment_strategy"),
                          F.when(n > 0, F.when(t >= 1, 800).otherwise(300)).alias("total_coverage_area_m"))
    return out.select(*keep, "p.*", "gps_verified", "setup_time_min", "deployment_strategy", "total_coverage_area_m")


def resource_timeline(requests: DataFrame, cause: str = "cause") -> DataFrame:
    """The response timeline of each request's cause as rows (phase, actions in order)."""
    steps = {k: F.array(*[F.struct(F.lit(ph).alias("phase"), F.lit(", ".join(acts)).alias("actions")) for ph, acts in v["timeline"]])
             for k, v in D.RESOURCE_TEMPLATES.items()}
    table = F.create_map(*[x for k, v in steps.items() for x in (F.lit(k), v)])
    out = requests.select(*requests.columns, F.posexplode(F.coalesce(table[F.col(cause)], steps["others"])).alias("seq", "s"))
    return out.select(*requests.columns, "seq", "s.phase", "s.actions")


def prediction_breakdown(requests: DataFrame, cause: str = "cause", tier: str = "tier", closure: str = "closure",
                         hour: str = "hour", weekday: str = "weekday", stress: str = "stress_index") -> DataFrame:
    """Six additive contributions in long form (one row per request × feature) plus the total.

    The six (value, points, impact) triples are plain columns first (one projection, whole-stage codegen), the
    total is their sum, and only then a six-element array of structs is exploded.
    """
    c, t, h, w = F.col(cause), F.col(tier), F.col(hour), F.col(weekday)
    closed = F.col(closure) == 1
    peak = h.isin(7, 8, 9, 17, 18, 19)
    night = (h >= 22) | (h <= 5)
    st1 = round_half(F.col(stress), 1)
    names = F.element_at(F.array(*[F.lit(n) for n in D.WEEKDAY_NAMES]), w + 1)
    pts = {
        "p0": F.when(closed, 45).otherwise(10),
        "p1": F.coalesce(D.literal_map({0: 15, 1: 35, 2: 28, 3: 20})[t], F.lit(20)),
        "p2": F.coalesce(D.literal_map(D.BREAKDOWN_CAUSE_POINTS)[c], F.lit(20)),
        "p3": F.when(peak, 25).when(night, 8).otherwise(15),
        "p4": F.when(w >= 5, 10).otherwise(18),
        "p5": F.when(st1.isNull(), F.lit(10)).otherwise(F.floor(st1 / 5)).cast("int"),
    }
    vals = {
        "v0": F.when(closed, "Yes").otherwise("No"),
        "v1": F.concat(F.lit("Tier "), t.cast("string")),
        "v2": title_cause(c),
        "v3": F.concat(h.cast("string"), F.lit(":00 ("),
                       F.when(peak, "Peak Hour").when(night, "Night").otherwise("Regular Hours"), F.lit(")")),
        "v4": names,
        "v5": F.when(st1.isNull(), "Unknown").otherwise(st1.cast("string")),
    }
    base = requests.select(*requests.columns, *[v.cast("int").alias(k) for k, v in pts.items()],
                           *[v.alias(k) for k, v in vals.items()])
    p = [F.col(f"p{i}") for i in range(6)]
    impacts = [F.when(closed, "High").otherwise("Low"),
               F.when(t == 1, "Critical").when(t == 2, "High").otherwise("Medium"),
               F.when(p[2] > 30, "Critical").when(p[2] > 20, "High").otherwise("Medium"),
               F.when(peak, "High").when(night, "Low").otherwise("Medium"),
               F.when(w >= 5, "Low").otherwise("Medium"),
               F.when(p[5] > 15, "High").otherwise("Medium")]
    feats = ["Road Closure", "Corridor Tier", "Incident Cause", "Time of Day", "Day of Week", "Corridor Stress Index"]
    items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), F.col(f"v{i}").alias("value"),
                               p[i].alias("contribution"), impacts[i].alias("impact")) for i, f in enumerate(feats)])
    total = p[0] + p[1] + p[2] + p[3] + p[4] + p[5]
    out = base.select(*requests.columns, F.explode(items).alias("f"), total.alias("total_estimated_score"))
    return out.select(*requests.columns, "f.*", "total_estimated_score")


def impact_narrative(cause: Column, count: Column, avg: Column, score: Column) -> Column:
    """The Formula-vs-AI narrative text (score printed with no decimals, half-even like Python)."""
    return F.when(count == 0, F.format_string("Limited historical data for %s incidents in this context.", cause)).otherwise(
        F.format_string("The AI learned that incidents with these characteristics historically evolve into "
                        "%s-severity events. Based on %d similar historical incidents with an average impact of %s, "
                        "the predicted score of %s aligns with observed patterns.",
                        F.when(avg >= 50, "high").otherwise("moderate"), count, avg.cast("string"),
                        F.bround(score, 0).cast("long").cast("string")))


def classify(score: Column) -> Column:
    return risk_class(score)


NON_CORRIDOR = "Non-corridor"


def what_if_variants(requests: DataFrame, tier1_corridor: str) -> DataFrame:
    """Up to six variants per request (toggle closure, Non-corridor, the tier-1 corridor ``tier1_corridor``,
    hour 9, hour 2, weekday↔weekend). A corridor variant is skipped only when the request already names that
    corridor, an hour variant when it already has that hour. One ``explode``; all request columns are carried."""
    t, c, h, w, name = F.col("tier"), F.col("closure"), F.col("hour"), F.col("weekday"), F.col("corridor")

    def v(variant, corridor, tier, closure, hour, weekday, cond=None):
        s = F.struct(F.lit(variant).alias("variant"), corridor.alias("corridor"), tier.cast("int").alias("tier"),
                     closure.cast("int").alias("closure"), hour.cast("int").alias("hour"), weekday.cast("int").alias("weekday"))
        return s if cond is None else F.when(cond, s)

    arr = F.array(
        v("closure_toggle", name, t, 1 - c, h, w),
        v("non_corridor", F.lit(NON_CORRIDOR), F.lit(0), c, h, w, ~name.eqNullSafe(F.lit(NON_CORRIDOR))),
        v("tier1_corridor", F.lit(tier1_corridor), F.lit(1), c, h, w, ~name.eqNullSafe(F.lit(tier1_corridor))),
        v("hour_9", name, t, c, F.lit(9), w, h != 9),
        v("hour_2", name, t, c, F.lit(2), w, h != 2),
        v("weekday_toggle", name, t, c, h, F.when(w < 5, 5).otherwise(2)))
    keep = [x for x in requests.columns if x not in ("corridor", "tier", "closure", "hour", "weekday", "variant")]
    e = requests.select(*keep, F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("v"))
    return e.select(*keep, "v.*")


def _request_score(requests: DataFrame, history: DataFrame, out: str) -> DataFrame:
    from .evidence import evidence_lookup
    base, _ = operational_baseline(F.col("cause"), F.col("tier"), F.col("closure"), F.col("hour"))
    e = evidence_lookup(requests, history)
    return e.select(*requests.columns, blend_score(base.cast("double"), F.col("evidence_count"), F.col("average_score"),
                                                   F.col("closure"), F.col("tier"), F.col("cause"), F.col("hour")).alias(out))


def what_if(requests: DataFrame, history: DataFrame, tier1_corridor: str) -> DataFrame:
    """Score, class and difference of every variant. The request's own score is computed first and carried
    through the ``explode``, so no row is shuffled by request."""
    v = what_if_variants(_request_score(requests, history, "base_score"), tier1_corridor)
    s = _request_score(v, history, "score")
    return s.select("request_id", "variant", F.col("score").alias("variant_score"),
                    risk_class(F.col("score")).alias("variant_class"), (F.col("score") - F.col("base_score")).alias("delta"))
