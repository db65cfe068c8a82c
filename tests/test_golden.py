"""Hand-computed golden rows: the reference's documented facts and the edge rows of FIXTURES.md §4."""

import datetime as dt

from pyspark.sql import functions as F

from eventimpact.functions import rules as R
from eventimpact.functions import temporal as T
from eventimpact.operators import evidence as EV
from eventimpact.operators import feedback as FB
from eventimpact.operators import forecast as FC
from eventimpact.operators import scoring as SC
from eventimpact.operators import stats as ST
from eventimpact.operators import windows as W
from eventimpact.operators.profiles import mode_of


def test_operational_baseline_documented_example(spark):
    # tree_fall + tier 1 + closure + hour 5 = 35 + 30 + 18 − 5 = 78
    df = spark.createDataFrame([("tree_fall", 1, 1, 5)], "cause string, tier int, closure int, hour int")
    s, comps = SC.operational_baseline(F.col("cause"), F.col("tier"), F.col("closure"), F.col("hour"))
    r = df.select(s.alias("s"), comps.alias("c")).first()
    assert r["s"] == 78
    assert r["c"] == "Road Closure:+35; Tier 1 Corridor:+30; Cause Severity (tree_fall):+18; Night Hours:-5"


def test_resources_and_placement_documented_example(spark):
    # tree_fall, Critical, tier 1: police 2×2×1.5 = 6, barricades 4×3 = 12 → placement 5 + 4 + 3
    req = spark.createDataFrame([(1, "tree_fall", "Critical", 1, None)],
                                "request_id int, cause string, risk_class string, tier int, vehicle_type string")
    r = SC.resource_scaling(req).first()
    assert (r["police_units"], r["barricades"], r["diversion_required"], r["total_multiplier"]) == (6, 12, True, "3.0x")
    p = SC.barricade_placement(SC.resource_scaling(req).select("request_id", "cause", "risk_class", "tier", "barricades"))
    counts = [x["count"] for x in p.orderBy("priority").collect()]
    assert counts == [5, 4, 3]


def test_barricade_totals_edge_rows(spark):
    # totals 0, 1, 2, 3, 12 on tier 0 / 1; n = 1 gives a primary of 2 (exceeds the total, as in the reference)
    rows = [(i, "accident", "High", t, n) for i, (t, n) in enumerate([(1, 0), (1, 1), (1, 2), (1, 3), (0, 12), (1, 12)])]
    req = spark.createDataFrame(rows, "request_id int, cause string, risk_class string, tier int, barricades int")
    got = {}
    for r in SC.barricade_placement(req).collect():
        got.setdefault(r["request_id"], []).append((r["priority"], r["count"]))
    assert got[0] == [(None, None)]                        # no barricades: one record without a placement
    assert got[1] == [(1, 2)] and got[2] == [(1, 2)] and got[3] == [(1, 2)]
    assert sorted(got[4]) == [(1, 5), (3, 7)]              # tier 0: no upstream point
    assert sorted(got[5]) == [(1, 5), (2, 4), (3, 3)]


def test_half_even_head_counts(spark):
    # Medium × tier 2 = 1.25: police 2 → 2.5 → 2 (half-even), text "1.2x" as Python formats 1.25
    req = spark.createDataFrame([(1, "accident", "Medium", 2, None)],
                                "request_id int, cause string, risk_class string, tier int, vehicle_type string")
    r = SC.resource_scaling(req).first()
    assert r["police_units"] == 2 and r["total_multiplier"] == "1.2x"


def test_risk_class_bounds(spark):
    df = spark.createDataFrame([(24.9,), (25.0,), (50.0,), (75.0,), (100.0,)], "s double")
    got = [r[0] for r in df.select(R.risk_class(F.col("s"))).collect()]
    assert got == ["Low", "Medium", "High", "Critical", "Critical"]
    got80 = [r[0] for r in df.select(R.risk_class(F.col("s"), (80, 60, 40))).collect()]
    assert got80 == ["Low", "Low", "Medium", "High", "Critical"]      # evaluation-notebook bounds (T8)


def test_night_and_rush_variants(spark):
    df = spark.createDataFrame([(h,) for h in (22, 23, 0, 5, 6, 10, 16, 20)], "h int")
    r = df.select("h", T.is_night(F.col("h"), "code").alias("nc"), T.is_night(F.col("h"), "serving").alias("ns"),
                  T.is_peak(F.col("h"), "code").alias("pc"), T.is_peak(F.col("h"), "rush").alias("pr")).collect()
    m = {x["h"]: x for x in r}
    assert m[22]["nc"] == 0 and m[22]["ns"] == 1 and m[23]["nc"] == 1 and m[6]["ns"] == 0 and m[5]["nc"] == 1
    assert m[10]["pr"] == 1 and m[10]["pc"] == 0 and m[16]["pr"] == 1 and m[20]["pr"] == 1 and m[20]["pc"] == 0


def test_crowd_and_rain_tiers(spark):
    df = spark.createDataFrame([(10000, 10.0), (30000, 25.0), (50000, 50.0), (50001, 50.1)], "c int, r double")
    got = [(a, b) for a, b in df.select(R.crowd_tier(F.col("c")), R.rain_risk(F.col("r"))).collect()]
    assert got == [(0, "Low"), (1, "Medium"), (2, "High"), (3, "Critical")]


def test_mode_tie_breaks_to_smallest_key(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("g", "a"), ("g", None), ("g", None), ("g", None)],
                               "g string, k string")
    assert mode_of(df, ["g"], "k", "m").first()["m"] == "a"       # NULL keys dropped, tie → 'a'


def test_evidence_ladder_rungs(spark):
    # 2 rows at (accident, 1, 1), 4 at (accident, 1, 0), 1 at (protest, 2, 0)
    hist = [("accident", 1, 1, 80.0)] * 2 + [("accident", 1, 0, 30.0)] * 4 + [("protest", 2, 0, 60.0)]
    h = spark.createDataFrame(hist, "event_cause string, corridor_tier int, requires_road_closure int, impact_score double")
    req = spark.createDataFrame([("accident", 1, 0), ("accident", 1, 1), ("protest", 2, 0), ("fire", 1, 1)],
                                "cause string, tier int, closure int")
    got = {(r["cause"], r["closure"]): (r["rung"], r["evidence_count"]) for r in EV.evidence_lookup(req, h).collect()}
    assert got[("accident", 0)] == (2, 6)      # 4 < 5 → cause + tier has 6 ≥ 3
    assert got[("accident", 1)] == (2, 6)
    assert got[("protest", 0)] == (3, 1)       # 1 → 1 → cause only
    assert got[("fire", 1)] == (3, 0)          # nothing: zeros


def test_feedback_zero_rules_and_drift_threshold(spark):
    rows = [("p0", 0.0, 50.0), ("p1", 50.0, 0.0), ("p2", 50.0, None), ("p3", 60.0, 40.0)]
    log = FB.with_errors(spark.createDataFrame(rows, "prediction_id string, predicted_impact double, actual_impact double"))
    e = {r["prediction_id"]: r["error_abs"] for r in log.collect()}
    assert e == {"p0": None, "p1": None, "p2": None, "p3": 20.0}
    base = dt.datetime(2024, 1, 30)
    mk = [(f"x{i}", base - dt.timedelta(days=1), 50.0, 52.0) for i in range(10)]
    l10 = FB.with_errors(spark.createDataFrame(mk, "prediction_id string, ts timestamp, predicted_impact double, actual_impact double"))
    assert FB.drift(l10, "2024-01-30 00:00:00").first()["status"] == "model_healthy"
    assert FB.drift(l10.limit(9), "2024-01-30 00:00:00").first()["status"] == "insufficient_data"


def test_two_non_corridor_events_conflict(spark):
    rows = [(1, dt.date(2024, 11, 1), 10, "Non-corridor", 0, 1000, "Low", 10.0),
            (2, dt.date(2024, 11, 1), 18, "Non-corridor", 0, 1000, "Low", 10.0)]
    f = spark.createDataFrame(rows, "event_id int, event_date date, hour int, corridor string, closure_required int, "
                                    "expected_crowd int, predicted_risk_class string, predicted_impact_score double")
    c = FC.event_conflicts(f).first()
    assert [r["type"] for r in c["rules"]] == ["Same Corridor Conflict"] and c["overall_severity"] == "High"


def test_bin_edges_and_percentile_ties(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,), (None,)], "x double")
    b = {r["x"]: r["b"] for r in ST.equal_width_bin(df, "x", "b").collect()}
    assert b == {0.0: 0, 1.0: 0, 2.0: 1, 10.0: 9, None: 0}       # right-closed: 1.0 sits on an inner edge
    p = {r["x"]: r["p"] for r in ST.percentile_rank(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double"),
                                                     "x", "p").collect()}
    assert p == {1.0: 0.25, 2.0: 0.625, 3.0: 1.0}


def test_windows_do_not_depend_on_partitioning(spark):
    import __spark_entry__ as E
    q = E.queries()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    res = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        res.append([sorted(q[k](spark, "/root/testdata/sf0.001").collect()) for k in
                    ("frequency_features", "expanding_closure_rate", "events_last_7days", "days_since_last")])
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert res[0] == res[1]


def test_quality_flags_centroid_fallback_holidays(spark):
    from eventimpact.sources import dims as D
    df = spark.createDataFrame(
        [(1, "Mysore Road", 0.0, 0.0, None, 77.6, dt.datetime(2024, 1, 26, 9)),
         (2, "Hosur Road", 12.9, 77.6, 12.91, 0.0, dt.datetime(2024, 1, 27, 9)),
         (3, "Unknown Rd", None, None, 12.9, 77.6, dt.datetime(2024, 1, 28, 9))],
        "id int, corridor string, latitude double, longitude double, endlatitude double, endlongitude double, start_datetime timestamp")
    he, cc = R.data_quality_flags(F.col("endlatitude"), F.col("endlongitude"), F.col("latitude"), F.col("longitude"))
    flags = {r["id"]: (r["he"], r["cc"]) for r in df.select("id", he.alias("he"), cc.alias("cc")).collect()}
    assert flags == {1: (1, 0), 2: (0, 1), 3: (1, 0)}                         # P13: NULL ≠ 0 counts as true
    fixed = {r["id"]: (r["latitude"], r["longitude"]) for r in
             ST.fallback_to_centroid(df, D.centroid_dim(spark)).collect()}
    assert fixed[1] == D.CORRIDOR_CENTERS["Mysore Road"] and fixed[2] == (12.9, 77.6) and fixed[3] == (None, None)
    assert ST.fallback_to_centroid(df, D.centroid_dim(spark), drop_invalid=True).count() == 1
    hol = spark.createDataFrame([("2024-01-26",)], "date string")
    h = {r["id"]: r["is_holiday"] for r in ST.with_holidays(df, hol).collect()}
    assert h == {1: 1, 2: 0, 3: 0}                                            # D11


def test_end_time_imputation_and_except(spark):
    df = spark.createDataFrame([(1, "2024-01-01 08:00:00", "2024-01-01 09:00:00", None),
                                (2, "2024-01-01 08:00:00", None, "2024-01-01 10:00:00"),
                                (3, "2024-01-01 08:00:00", None, None)],
                               "id int, s string, e string, r string")
    df = df.select("id", *[F.to_timestamp(c).alias(c) for c in ("s", "e", "r")])
    got = {r["id"]: r["duration_minutes"] for r in ST.impute_end(df, "s", "e", "r").collect()}
    assert got == {1: 60.0, 2: 120.0, 3: 90.0}                                # P17 then the median (F14)
    assert ST.impute_end(df, "s", "e", "r").select("id").exceptAll(df.select("id")).count() == 0   # U04


def test_prediction_id_geojson_nan(spark):
    from eventimpact.operators import diversion as DV
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 678901), "accident", float("nan")),
                                (dt.datetime(2024, 1, 2, 3, 4, 5, 678901), "protest", float("inf"))],
                               "ts timestamp, cause string, x double")
    ids = [r[0] for r in df.select(FB.prediction_id(F.col("ts"), F.col("cause"))).collect()]
    assert all(i.startswith("PRED_20240102030405678901_") for i in ids) and len(set(ids)) == 2     # G07
    assert [r[0] for r in df.select(R.nan_to_null(F.col("x"))).collect()] == [None, None]          # P16
    routes = DV.route_dim(spark).filter("route_no = 1 AND r_corridor = 'Mysore Road'").withColumn(
        "route_type", F.lit("alternate_1"))
    g = DV.route_geojson(routes).first()["geojson"]
    assert '"coordinates":[[77.55,12.94],[77.565,12.955]]' in g and '"color":"#10b981"' in g      # N04


def test_profile_json_sink(spark):
    import os
    import tempfile
    from eventimpact.operators.profiles import top_k_array
    from eventimpact.sources import files as S
    df = spark.createDataFrame([("C1", "a"), ("C1", "a"), ("C1", "b"), ("C2", "c")], "corridor string, event_cause string")
    prof = top_k_array(df, ["corridor"], "event_cause", 3, "cause")
    p = os.path.join(tempfile.mkdtemp(prefix="ei-prof-"), "p")
    S.write_profile(prof, p)                                                                        # S06
    back = {r["corridor"]: [(x["cause"], x["count"]) for x in r["top_causes"]] for r in spark.read.json(p).collect()}
    assert back == {"C1": [("a", 2), ("b", 1)], "C2": [("c", 1)]}                                  # N01


def test_trailing_count_boundaries_against_bruteforce(spark):
    base = dt.datetime(2024, 1, 10, 0, 0, 0)
    times = [base, base, base + dt.timedelta(days=7), base + dt.timedelta(days=7, microseconds=-1),
             base + dt.timedelta(days=7, hours=5), base + dt.timedelta(days=3, hours=23, minutes=59),
             base + dt.timedelta(days=14), base - dt.timedelta(days=1), None]
    rows = [(i, "K" if i % 4 else "Q", t) for i, t in enumerate(times)] + [(100, None, base)]
    df = spark.createDataFrame(rows, "id long, k string, start_datetime timestamp")
    got = {r["id"]: r["n"] for r in W.trailing_count(df, "k", "n").collect()}
    want = {}
    for i, k, t in rows:
        want[i] = 0 if (k is None or t is None) else sum(
            1 for j, k2, t2 in rows if k2 == k and t2 is not None and t - dt.timedelta(days=7) <= t2 < t)
    assert got == want


def test_weak_spots_fire(spark):
    # cause "a": 3 rows with error 10 (MAE 10 > 7); closure rows error 10 (> 8); night rows (≥ 5) error 10 vs day 2
    rows = [(f"a{i}", "a", 1, 23, 50.0, 60.0) for i in range(3)] + \
           [(f"n{i}", "b", 0, 2, 50.0, 60.0) for i in range(3)] + \
           [(f"d{i}", "c", 0, 12, 50.0, 52.0) for i in range(6)] + \
           [("x0", "z", 0, 3, 50.0, 100.0), ("x1", "z", 0, 3, 50.0, 100.0)]     # MAE 50 but only 2 rows
    log = FB.with_errors(spark.createDataFrame(
        rows, "prediction_id string, cause string, closure int, hour int, predicted_impact double, actual_impact double"))
    got = {(r["category"], r["value"]): r["avg_error"] for r in FB.weak_spots(log).collect()}
    assert got == {("cause", "a"): 10.0, ("closure_events", "Road closure cases"): 10.0,
                   ("temporal", "Night hours (22:00-6:00)"): 20.0}       # night (60 + 100) / 8 vs day 2
