"""Ranges of a key order by binary search: the same as counting, and planned at once however many there are."""

import time

import numpy as np
from pyspark.sql import functions as F

from eventimpact.operators import stats as S


def test_a_range_is_the_number_of_smaller_points(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a) if a < 9 else None, f"k{b}", float(c)) for a, b, c in zip(rng.integers(0, 10, 600), rng.integers(0, 5, 600), rng.normal(size=600))]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    points = df.select("a", "b", "c").distinct().orderBy("a", "b", "c").collect()[5::13]
    got = S.with_range(df, ["a", "b", "c"], points, "r").collect()
    key = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    for r in got:
        assert r.r == sum(key(p) < key((r.a, r.b, r.c)) for p in points)
    assert S.with_range(df, ["a"], [], "r").filter("r <> 0").count() == 0


def test_planning_does_not_grow_with_the_ranges(spark):
    df = spark.range(0, 100_000).select((F.col("id") * 7919 % 100_003).alias("k"), F.lit(1).alias("w"))
    size, seconds = {}, {}
    for n in (64, 4096):
        points = S.split_points(df, ["k"], n, 8)
        assert len(points) == n - 1
        t0 = time.perf_counter()
        out = S.with_range(df, ["k"], points, "r")
        size[n] = len(out._jdf.queryExecution().optimizedPlan().toString())
        out._jdf.queryExecution().executedPlan()
        seconds[n] = time.perf_counter() - t0
        counts = [r["count"] for r in out.groupBy("r").count().collect()]
        assert len(counts) == n and max(counts) < 12 * 100_000 / n
    assert size[4096] < 2 * size[64] and seconds[4096] < 1.5


def test_running_total_over_many_ranges(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7 % 3001).alias("k"), (F.col("id") % 5).alias("w"))
    want, total = {}, 0
    for r in df.orderBy("k").collect():
        total += r.w
        want[r.k] = total
    got = {r.k: r.c for r in S.running_total(df, "k", "w", "c", 40).collect()}
    assert got == want


def test_quantiles_evaluate_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    d = spark.range(1000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").cast("double").alias("x")).mapInArrow(count, "g long, x double")
    got = {r.g: r.m for r in S.exact_quantiles(d, "x", [0.5], ["g"], ["m"]).collect()}
    assert seen.value == 1000
    want = spark.range(1000).groupBy((F.col("id") % 2).alias("g")).agg(F.median(F.xxhash64("id").cast("double")).alias("m")).collect()
    assert all(abs(got[r.g] / r.m - 1) < 1e-12 for r in want)
