"""Hand-written raw inputs (reference-shaped, FIXTURES.md §3) through the file sources and sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from eventimpact.operators import feedback as FB
from eventimpact.operators import weather as WE
from eventimpact.sources import files as S

RAW = """id,event_cause,event_type,start_datetime,end_datetime,latitude,longitude,endlatitude,endlongitude,corridor,police_station,junction,veh_type,requires_road_closure,authenticated,description
a1,tree_fall,unplanned,2024-03-01 08:15:00,2024-03-01 09:45:00,12.97,77.59,0,0,Mysore Road,S1,J1,BMTC Bus,true,yes,Tree on road
a2,,planned,not a date,2024-03-01 10:00:00,,,,,,,,,false,no,
a3,accident,unplanned,2024-03-02 23:00:00,2024-03-02 22:00:00,12.95,77.60,12.96,77.61,Hosur Road,S2,,Truck,true,no,ಮರ ಬಿದ್ದಿದೆ
"""


def _tmp(name, text):
    d = tempfile.mkdtemp(prefix="ei-src-")
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_raw_csv_permissive_and_cleaning(spark):
    raw = S.read_raw_incidents(spark, _tmp("raw.csv", RAW))
    rows = {r["id"]: r for r in S.clean_incidents(raw).collect()}
    assert rows["a2"]["start_datetime"] is None and rows["a2"]["hour"] is None      # P01 unparseable → NULL
    assert rows["a2"]["corridor"] == "Non-corridor" and rows["a2"]["event_cause"] == "others"   # P02
    assert rows["a1"]["authenticated_flag"] == 1 and rows["a3"]["authenticated_flag"] == 0      # P12
    assert rows["a1"]["duration_minutes"] == 90.0 and rows["a3"]["duration_minutes"] == -60.0   # D06, end < start
    assert rows["a1"]["hour"] == 8 and rows["a1"]["weekday"] == 4                               # D01 (Fri = 4)


def test_planned_events_csv(spark):
    csv = ("event_id,event_name,event_type,date,start_time,end_time,corridor,location,latitude,longitude,"
           "expected_crowd,closure_required,tier_affected\n"
           "1,Fest,festival,2024-11-01,18:00:00,23:00:00,Mysore Road,X,12.9,77.5,50000,TRUE,1\n"
           "2,Late,rally,2024-12-31,22:30:00,01:00:00,Non-corridor,Y,12.9,77.5,50001,FALSE,0\n")
    rows = {r["event_id"]: r for r in S.read_planned_events(spark, _tmp("p.csv", csv)).collect()}
    assert rows[1]["hour"] == 18 and rows[1]["closure_required"] is True
    assert rows[2]["hour"] == 22 and rows[2]["weekday"] == 1


def test_resource_template_json(spark):
    doc = {"tree_fall": {"timeline": [{"phase": "0-15 min", "actions": ["a", "b"]}],
                         "resolution": {"median": "1.2h", "range": "0.4h–4.0h"},
                         "resources": {"police": 2, "barricades": 4, "crew": "BBMP Tree Crew", "tow": 0, "diversion": True}},
           "others": {"timeline": [], "resolution": {"median": "2.0h", "range": "1.0h–4.0h"},
                      "resources": {"police": 1, "barricades": 1, "crew": "Standard", "tow": 0, "diversion": False}}}
    t = {r["cause"]: r for r in S.read_resource_templates(spark, _tmp("r.json", json.dumps(doc))).collect()}
    assert t["tree_fall"]["resources"]["barricades"] == 4 and t["tree_fall"]["timeline"][0]["actions"] == ["a", "b"]


def test_sinks_and_log_roundtrip(spark):
    base = tempfile.mkdtemp(prefix="ei-sink-")
    df = spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "id long, month int, v string")
    S.write_feature_table(df, os.path.join(base, "ft"))
    assert [p for p in sorted(os.listdir(os.path.join(base, "ft"))) if p.startswith("month=")] == ["month=1", "month=2"]
    assert spark.read.parquet(os.path.join(base, "ft")).filter("month = 2").count() == 1   # partition pruning
    log_path = os.path.join(base, "log")
    assert S.read_log_or_empty(spark, log_path).count() == 0                               # S07 typed empty
    S.append_log(spark.createDataFrame([("p1", 40.0)], "prediction_id string, predicted_impact double"), log_path)
    S.append_log(spark.createDataFrame([("p2", 60.0)], "prediction_id string, predicted_impact double"), log_path)
    log = S.read_log_or_empty(spark, log_path)
    assert log.count() == 2 and log.schema == FB.empty_log(spark).schema


def test_weather_json(spark):
    obs = {"weather": [{"main": "Rain", "description": "light rain"}], "main": {"temp": 24.0, "humidity": 80},
           "dt": 1700000000}
    fc = {"list": [{"dt_txt": "2024-01-01 00:00:00", "weather": [{"main": "Rain"}], "main": {"temp": 22.0},
                    "pop": 0.8, "rain": {"3h": 10.0}},
                   {"dt_txt": "2024-01-01 03:00:00", "weather": [{"main": "Clouds"}], "main": {"temp": 21.0}}]}
    o = WE.observations(spark.read.schema(WE.OBSERVATION_SCHEMA).json(_tmp("o.json", json.dumps(obs)))).first()
    assert o["rain_1h_mm"] == 0.0 and o["visibility_m"] == 10000                            # S09 defaults
    items = WE.forecast_items(spark.read.schema(WE.FORECAST_SCHEMA).json(_tmp("f.json", json.dumps(fc)))).collect()
    assert [i["rain_3h_mm"] for i in items] == [10.0, 0.0] and items[1]["rain_prob"] == 0.0  # S10 defaults
