"""Centroid clustering against plain Lloyd rounds in integers."""

import hashlib
import math

import numpy as np

from eventimpact.llm import centroids

DIM = 64


def plain(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == DIM and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in c]
            out.append((i, d.index(min(d)), min(d), v))
        return out
    for _ in range(rounds):
        got = assign()
        for j in range(len(c)):
            mine = [v for _, a, _, v in got if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = assign()
    by = {j: sum(d for _, a, d, _ in got if a == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted((-1 if i is None else i, a, d, by[a], sum(by.values()), sha[a]) for i, a, d, _ in got)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, Distance string")
    got = centroids.cluster(df, **more).collect()
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


def test_equals_plain_rounds_and_scans_less(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, DIM))
    x = middle[rng.integers(0, 12, 2500)] + rng.normal(size=(2500, DIM)) * 0.35
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    log = []
    assert run(spark, rows, log=log) == plain(rows)
    assert log[0] == 2500 and sum(log[1:]) < 0.8 * 2500 * len(log[1:])


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, DIM)).round(2)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(100, None), (101, [0.5] * 63), (102, [0.5] * 63 + [None]), (103, [0.5] * 63 + [float("nan")]), (104, [float("-inf")] * 64), (105, [])]
    rows += [(200 + i, [0.25] * 64) for i in range(30)] + [(7, [0.25] * 64), (7, [0.25] * 64), (None, [-0.3] * 64), (106, [0.0] * 64)]
    assert run(spark, rows) == plain(rows)
    few = rows[:3]
    assert run(spark, few) == plain(few)
    same = [(i, [1.0] * 64) for i in range(20)]                        # seven centroids stay empty
    assert run(spark, same) == plain(same)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_loosening_is_a_bound_below_the_drift():
    rng = np.random.default_rng(7)
    gained = 0
    for _ in range(200):
        k, dim = 5, int(rng.integers(2, 6))
        old = rng.integers(-50, 50, (k, dim))
        new = old + rng.integers(-6, 7, (k, dim))
        radius = rng.uniform(0, 30, k)
        bound = centroids.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for a in range(k):
            u = rng.normal(size=(300, dim))
            x = old[a] + u / np.linalg.norm(u, axis=1)[:, None] * radius[a] * rng.uniform(0, 1, (300, 1)) ** 0.2
            for j in range(k):
                if j != a:
                    fall = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                    assert fall.max() <= bound[a] + 1e-9
            assert bound[a] <= max(drift[j] for j in range(k) if j != a) + 1e-9
            gained += bound[a] < max(drift[j] for j in range(k) if j != a) - 1e-3
    assert gained > 300


def test_wide_components_stay_exact():
    rng = np.random.default_rng(8)
    x, c = rng.integers(-(1 << 27), 1 << 27, (20, 64)), rng.integers(-(1 << 27), 1 << 27, (3, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)) for m in c] for v in x]
    assert centroids.squared(x, c).tolist() == want
