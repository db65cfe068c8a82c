"""L09 against a brute-force sequential DBSCAN on a hand-built fixture (clusters, border, noise, NULL, duplicates)."""

import math

from eventimpact.operators.clustering import dbscan, neighbour_counts


def brute_dbscan(pts, eps, min_samples):
    n = len(pts)
    nb = []
    for i, (a, b) in enumerate(pts):
        if a is None:
            nb.append(None)
            continue
        nb.append([j for j, (c, d) in enumerate(pts) if c is not None and math.sqrt((a - c) ** 2 + (b - d) ** 2) <= eps])
    core = [x is not None and len(x) >= min_samples for x in nb]
    lab = [-1] * n
    cid = 0
    for i in range(n):
        if not core[i] or lab[i] != -1:
            continue
        stack, lab[i] = [i], cid
        while stack:
            k = stack.pop()
            for j in nb[k]:
                if lab[j] == -1:
                    lab[j] = cid
                    if core[j]:
                        stack.append(j)
        cid += 1
    return lab, core


def test_dbscan_matches_bruteforce(spark):
    pts = []
    for i in range(6):                      # dense cluster A
        pts.append((12.90 + i * 0.002, 77.50))
    pts.append((12.90 + 5 * 0.002 + 0.009, 77.50))   # border of A
    for i in range(5):                      # cluster B with a duplicate coordinate
        pts.append((13.10, 77.70 + (i % 4) * 0.003))
    pts.append((13.40, 77.90))              # noise
    pts.append((None, None))                # missing coordinates → −1
    rows = [(i, a, b) for i, (a, b) in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    got = {r["id"]: r["geo_cluster"] for r in dbscan(df, 0.01, 5).collect()}
    want, core = brute_dbscan(pts, 0.01, 5)
    # same partition into clusters (labels renumbered in discovery order in both)
    assert [got[i] for i in range(len(pts))] == want
    nc = {r["id"]: r["is_core"] for r in neighbour_counts(df, 0.01, 5).collect()}
    assert [bool(nc[i]) if nc[i] is not None else False for i in range(len(pts))] == core


def test_dbscan_lattice_with_exact_eps_distances(spark):
    # 0.001° lattice: many pairs sit exactly at distance eps (0.006² + 0.008² = 0.01²), duplicates included
    pts = [(12.5 + ((i * 37) % 60) / 1000.0, 77.0 + ((i * 91) % 60) / 1000.0) for i in range(240)]
    pts += [(13.2 + (i % 3) * 0.004, 77.9) for i in range(4)]            # a sparse clump (noise or border)
    rows = [(i, a, b) for i, (a, b) in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    for eps, ms in ((0.01, 5), (0.004, 3)):
        want, core = brute_dbscan(pts, eps, ms)
        got = {r["id"]: r["geo_cluster"] for r in dbscan(df, eps, ms).collect()}
        assert [got[i] for i in range(len(pts))] == want
        nc = {r["id"]: r["is_core"] for r in neighbour_counts(df, eps, ms).collect()}
        assert [bool(nc[i]) for i in range(len(pts))] == core


def test_dense_rim_cells_cost_far_fewer_rows_than_pairs(spark):
    """k distinct points in each of two cells that the rim of the disks crosses: rows examined grow like k^1.5 at most."""
    import numpy as np
    from pyspark.sql import functions as F

    from eventimpact.operators import clustering as C
    eps, s, rows = 0.01, 0.0025, {}
    for k in (1000, 10_000):
        rng = np.random.default_rng(k)
        x, y = rng.random(2 * k), rng.random(2 * k)
        lon, lat = np.where(np.arange(2 * k) < k, x, 3 + x) * s, y * s
        pts = spark.createDataFrame([(i, float(a), float(b), 1) for i, (a, b) in enumerate(zip(lat, lon))], "pid long, lat double, lon double, w int")
        probe = pts.select(F.col("pid").alias("key"), "lat", "lon", F.when(F.col("pid") < k, 3).otherwise(0).cast("long").alias("tx"),
                           F.lit(0).cast("long").alias("ty"))
        log = []
        got = {r.key: r.n for r in C.disk_reach(probe, pts, eps, s, log=log).groupBy("key").agg(F.sum("w").alias("n")).collect()}
        a, b = slice(0, k), slice(k, 2 * k)
        for i in range(0, k, 97):
            d = np.sqrt((lat[i] - lat[b]) * (lat[i] - lat[b]) + (lon[i] - lon[b]) * (lon[i] - lon[b]))
            assert got.get(i, 0) == int((d <= eps).sum())
            d = np.sqrt((lat[k + i] - lat[a]) ** 2 + (lon[k + i] - lon[a]) ** 2)
            assert got.get(k + i, 0) == int((d <= eps).sum())
        rows[k] = sum(log)
        # an edge between the two cells is found at once: few points have to ask
        log = []
        pair = probe.filter(F.col("pid" if "pid" in probe.columns else "key") < k).withColumn("key", F.lit("edge"))
        assert C.disk_reach(pair, pts, eps, s, first=True, log=log).distinct().count() == 1
        assert sum(log) < 40 * k
    assert rows[1000] < 0.3 * 2 * 1000**2 and rows[10_000] < 0.06 * 2 * 10_000**2
    assert rows[10_000] / rows[1000] < 45
