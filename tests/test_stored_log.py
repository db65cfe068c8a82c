"""Keyed updates of the stored prediction log, its compaction, and the quarantine of bad rows."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from eventimpact.operators import feedback as FB
from eventimpact.plans import q_quality as Q
from eventimpact.sources import files as SF
from paths import SF_SMALL


def _files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def _log(spark, path, ids):
    d = spark.createDataFrame([(i, float(i)) for i in ids], "prediction_id long, predicted_impact double")
    FB.write_log(d.withColumns({"actual_impact": F.lit(None).cast("double"), "reported_at": F.lit(None).cast("string")}), path, 16)


def _reports(spark, rows):
    return spark.createDataFrame(rows, "prediction_id long, line int, reported_at string, actual_impact double")


def test_outcomes_are_merged_by_bucket(spark):
    path = tempfile.mkdtemp(prefix="ei-log-") + "/log"
    _log(spark, path, range(200))
    before = _files(path)
    reports = _reports(spark, [(7, 2, "2024-01-02", 70.0), (7, 1, "2024-01-02", 71.0), (7, 1, "2024-01-03", 72.0), (9, 1, "2024-01-01", 90.0),
                               (900, 1, "2024-01-01", 1.0), (901, 1, "2024-01-01", 1.0)])
    unknown = FB.update_log(spark, path, reports, ["reported_at", "line"], 16)
    assert sorted(r.prediction_id for r in unknown.collect()) == [900, 901]
    got = {r.prediction_id: (r.actual_impact, r.reported_at) for r in spark.read.parquet(path).filter("actual_impact is not null").collect()}
    assert got == {7: (71.0, "2024-01-02"), 9: (90.0, "2024-01-01")} and spark.read.parquet(path).count() == 200
    after = _files(path)
    kept = set(before) & set(after)
    assert len({f.split("bucket=")[1].split("/")[0] for f in set(before) - kept}) <= 2 and all(before[f] == after[f] for f in kept)
    assert len(kept) >= len(before) - 2
    # a replay, and a later report of a known id, change nothing: not even a file
    for again in (reports, _reports(spark, [(9, 1, "2023-01-01", 5.0)])):
        FB.update_log(spark, path, again, ["reported_at", "line"], 16)
        assert _files(path) == after


def test_compaction_bounds_the_files(spark):
    path = tempfile.mkdtemp(prefix="ei-log-") + "/log"
    for k in range(6):
        _log(spark, path, range(100 * k, 100 * k + 100))
    rows = sorted(map(tuple, spark.read.parquet(path).collect()), key=str)
    full = FB.compact_log(spark, path, 4)
    per = {}
    for f in _files(path):
        per.setdefault(f.split("bucket=")[1].split("/")[0], []).append(f)
    assert full and max(map(len, per.values())) <= 4 and all(len(per[str(b)]) == 1 for b in full)
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == rows
    assert FB.compact_log(spark, path, 4) == []


def test_good_and_bad_rows_are_all_lines(spark):
    lines, header = Q.raw_lines(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="ei-raw-")
    rows = [r.value for r in lines.collect()]
    for i in range(2):
        with open(f"{path}/part{i}.csv", "w") as f:
            f.write("\n".join([header, *rows[i::2]]) + "\n")
    good, bad = SF.read_with_quarantine(spark, path)
    reasons = {r.reason: r["count"] for r in bad.groupBy("reason").count().collect()}
    want = {}
    for r in lines.sparkSession.createDataFrame([(x,) for x in rows], "value string").collect():
        n = r.value.replace('"a text, with a comma"', "x").count(",") + 1
        f = r.value.split(",")
        kind = "short line" if n < 16 else "long line" if n > 16 else "wrong type" if f[5] == "north" else "no time" if f[3] == "" else \
            "unparsable time" if f[3] == "the day before" else None
        if kind:
            want[kind] = want.get(kind, 0) + 1
    assert reasons == want and len(want) == 5 and good.count() + sum(reasons.values()) == len(rows)
    raw = {r.line for r in bad.filter("reason = 'short line'").collect()}
    assert raw <= set(rows)
