"""Long chains, hot keys, exchange reuse and URI paths: what must not change with size or settings."""

import numpy as np
from pyspark.sql import functions as F

from eventimpact.operators import clustering as CL
from eventimpact.operators import stats as S
from eventimpact.operators import windows as W
from eventimpact.operators.graph import connected_components
from eventimpact.sources import files as FS


def test_components_of_a_long_chain(spark):
    e = spark.range(700).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionAll(
        spark.range(1000, 1200).select(F.lit(1000).cast("long").alias("u"), F.col("id").alias("v")))
    rows = connected_components(e).collect()
    assert {r.node: r.component for r in rows} == {**{i: 0 for i in range(701)}, **{i: 1000 for i in range(1000, 1200)}}


def test_a_chain_of_core_points_is_one_cluster(spark):
    d = spark.range(2000).select("id", (12.5 + F.col("id") * 0.002).alias("latitude"), F.lit(77.5).alias("longitude"))
    assert {r.geo_cluster for r in CL.dbscan(d).collect()} == {0}


def test_ranks_do_not_depend_on_exchange_reuse(spark):
    d = spark.range(20_000).select("id", ((F.col("id") * 7919) % 20_000).alias("x"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.x: r.p for r in S.percentile_rank(d, "x", "p").collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    assert all(abs(got[x] - (x + 1) / 20_000) < 1e-12 for x in range(20_000))


def test_exact_quantiles_per_group(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in (("a", 1000), ("b", 7), (None, 30)) for v in rng.integers(0, 50, n)] + [("c", None)]
    got = {r.g: (r.q0, r.q1, r.n) for r in S.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0.5, 0.9], ["g"]).collect()}
    for g in ("a", "b", None):
        v = [x for k, x in rows if k == g and x is not None]
        assert np.allclose(got[g][:2], np.quantile(v, [0.5, 0.9])) and got[g][2] == len(v)
    assert "c" not in got


def test_one_key_holds_all_rows_of_one_day(spark):
    d = spark.range(3000).select("id", F.lit("hot").alias("k"), (F.col("id") % 2).cast("int").alias("flag"),
                                 F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20).alias("start_datetime"))
    d = W.prior_count(d, "k", "n")
    d = W.expanding_rate(d, "k", "flag", "incl", "prior")
    d = W.trailing_count(d, "k", "week")
    d = W.days_since_last(d, "k", "gap")
    for r in d.collect():
        assert r.n == r.id == r.week and abs(r.incl - ((r.id + 1) // 2) / (r.id + 1)) < 1e-12
        assert r.gap is None if r.id == 0 else abs(r.gap - 20 / 86400) < 1e-12


def test_log_is_found_by_uri(spark, tmp_path):
    uri = f"file:{tmp_path}/log"
    assert FS.read_log_or_empty(spark, uri).count() == 0
    FS.append_log(spark.createDataFrame([("p1",)], "prediction_id string"), f"{tmp_path}/log")
    assert FS.read_log_or_empty(spark, uri).count() == 1
