"""Boosting against a plain numpy booster; the reference's grids; importance; seeded draws."""

import inspect
import pickle
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventimpact.functions import rules as R
from eventimpact.operators import boosting as B
from eventimpact.operators import forecast as FC
from eventimpact.operators import ml as ML


def plain_tree(x, g, depth, l2, cuts):
    """Nested (feature, cut, left, right) or leaf value, grown level by level on binned rows."""
    if depth == 0:
        return -g.sum() / (len(g) + l2)
    best = None
    for f in range(x.shape[1]):
        for c in range(cuts[f]):
            left = x[:, f] <= c
            if left.any() and not left.all():
                a, b = g[left], g[~left]
                gain = a.sum() ** 2 / (len(a) + l2) + b.sum() ** 2 / (len(b) + l2) - g.sum() ** 2 / (len(g) + l2)
                if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-12)):
                    best = gain, f, c
    if best is None:
        return -g.sum() / (len(g) + l2)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], plain_tree(x[left], g[left], depth - 1, l2, cuts), plain_tree(x[~left], g[~left], depth - 1, l2, cuts)


def plain_value(t, row):
    while isinstance(t, tuple):
        t = t[2] if row[t[0]] <= t[1] else t[3]
    return t


def plain_boost(x, y, train, val, spec, cuts):
    pred = np.full(len(y), y[train].mean())
    out, errors = [pred.copy()], [((pred - y)[val] ** 2).mean()]
    while len(errors) - 1 < spec.rounds and len(errors) - 1 - int(np.argmin(errors)) < spec.patience:
        t = plain_tree(x[train], (pred - y)[train], spec.depth, spec.l2, cuts)
        pred = pred + spec.rate * np.array([plain_value(t, r) for r in x])
        out.append(pred.copy())
        errors.append(((pred - y)[val] ** 2).mean())
    return out[int(np.argmin(errors))], errors


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 2, 500), rng.integers(0, 12, 500), rng.normal(size=500), rng.integers(0, 3, 500)], 1).astype(float)
    y = 20 * x[:, 0] + 3 * np.abs(x[:, 1] - 6) + 8 * np.sin(2 * x[:, 2]) + 5 * x[:, 0] * x[:, 3] + rng.normal(0, 1.5, 500)
    z = x[:, 1] * x[:, 3] + rng.normal(0, 4, 500)
    part = rng.integers(0, 5, 500)
    return x, y, z, part


@pytest.fixture(scope="module")
def frame(spark, rows):
    x, y, z, part = rows
    data = [(i, *map(float, r), float(a), float(b), bool(p > 1), bool(p == 1)) for i, (r, a, b, p) in enumerate(zip(x, y, z, part))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, y double, z double, is_train boolean, is_val boolean").repartition(3)


FEATURES = ["a", "b", "c", "d"]


@pytest.mark.parametrize("small", [100_000, 60, 0])
def test_models_of_a_batch_equal_a_plain_booster(spark, frame, rows, small, monkeypatch):
    monkeypatch.setattr(B, "SMALL", small)                             # whole trees, some subtrees or none in one task
    x, y, z, part = rows
    borders = B.bin_borders(frame, FEATURES, "id")
    assert max(map(len, borders)) <= B.BINS - 1
    binned = np.stack([np.searchsorted(b, x[:, i], "left") for i, b in enumerate(borders)], 1)
    specs = [B.Spec("y", 3, 0.3, 2.0, rounds=25, patience=4), B.Spec("z", 2, 0.2, 4.0, rounds=60, patience=3), B.Spec("y", 4, 0.1, 3.0, rounds=13)]
    models = B.fit_many(frame, FEATURES, specs, borders=borders)
    got = {r.id: r for r in B.predict(frame.select("id", *FEATURES), {f"p{i}": m for i, m in enumerate(models)}).collect()}
    for i, (s, m) in enumerate(zip(specs, models)):
        want, errors = plain_boost(binned, y if s.label == "y" else z, part > 1, part == 1, s, [len(b) for b in borders])
        assert np.allclose(m.errors, errors, rtol=1e-9) and len(m.trees) == int(np.argmin(errors))
        assert max(abs(got[k][f"p{i}"] - want[k]) for k in range(500)) < 1e-9
    assert len(models[1].errors) - 1 < 60 and len(models[2].trees) == 13                    # one stopped early, one ran out


def test_models_of_gathered_rows_equal_a_plain_booster(spark, frame, rows, monkeypatch):
    test_models_of_a_batch_equal_a_plain_booster(spark, frame, rows, 1000, monkeypatch)


@pytest.mark.parametrize("seed", [2, 3])
def test_gathered_rows_have_the_sums_of_all_rows(seed, monkeypatch):
    monkeypatch.setattr(B, "JOINT", 16)
    rng = np.random.default_rng(seed)
    width = np.array([3, 3, 20, 2, 1, 5])
    bins = np.stack([rng.integers(0, w, 3000) for w in width], 1).astype(np.uint8)
    bins[:, 1], bins[:, 2] = (bins[:, 0] + 1) % 3, np.where(rng.random(3000) < 0.9, 0, bins[:, 2])
    y, part, offset = rng.normal(size=3000), rng.integers(1, 4, 3000).astype(np.uint8), np.concatenate([[0], np.cumsum(width)[:-1]])
    r = B.Gathered(bins, y, part, width, offset)
    assert len(r.bins) < 3000 == r.weight.sum() and sum(len(x[3]) for x in r.groups) == width.sum() and len(r.groups) < 6
    p, of = bins @ np.arange(6.0), r.bins @ np.arange(6.0)                                  # the same for equal rows
    assert np.isclose(r.spread + (r.weight * (of - r.mean) ** 2)[r.val].sum(), ((p - y)[part >= 2] ** 2).sum())
    got = r.sums(r.bins[r.train, 3].astype(np.int64), 2, (r.weight * (of - r.mean))[r.train], int(width.sum()))
    for node in range(2):
        mine = (part & 1 > 0) & (bins[:, 3] == node)
        for f, w in enumerate(width):
            at = slice(offset[f], offset[f] + w)
            assert np.allclose(got[0, node, at], np.bincount(bins[mine, f], (p - y)[mine], w))
            assert np.array_equal(got[1, node, at], np.bincount(bins[mine, f], minlength=w))


def test_kept_rows_have_the_very_sums_of_all_rows_without_a_copy_per_feature():
    rng = np.random.default_rng(4)
    width = np.array([3, 3, 20, 2, 1, 64, 64, 64, 64, 64])
    bins = np.stack([rng.integers(0, w, 20_000) for w in width], 1).astype(np.uint8)
    bins[:, 1] = (bins[:, 0] + 1) % 3
    y, part, offset, cells = rng.normal(size=20_000), rng.integers(1, 4, 20_000).astype(np.uint8), np.concatenate([[0], np.cumsum(width)[:-1]]), int(width.sum())
    r, train = B.Kept(bins, y, part, width, offset), part & 1 > 0
    g, node = r.gradients(np.zeros(20_000)), bins[train, 3].astype(np.int64) * 3 + bins[train, 0]
    assert np.array_equal(g, -y[train]) and r.error(np.zeros(20_000)) == (y[part >= 2] ** 2).mean() and len(r.groups) < len(width)
    where = (node[:, None] * cells + bins[train] + offset).ravel()
    want = [np.bincount(where, x, 6 * cells).reshape(6, cells) for x in (np.repeat(g, len(width)), np.ones(len(where)))]
    tracemalloc.start()
    got = r.sums(node, 6, g, cells)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want)                                         # to the last bit
    assert peak < 8 * train.sum() * len(width) / 2                           # less than half of one number per row and feature


def test_jobs_of_a_model_of_many_rows_do_not_grow_with_its_rounds(spark):
    d = spark.range(130_000).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.xxhash64("id") % 50).cast("double").alias("y"),
                                    (F.col("id") % 5 > 0).alias("is_train"), (F.col("id") % 5 == 0).alias("is_val"))
    jobs, sc = [], spark.sparkContext
    for rounds in (2, 6):
        sc.setJobGroup(f"rounds-{rounds}", "")
        assert len(B.fit_many(d, ["a"], [B.Spec("y", 2, rounds=rounds)])[0].errors) == rounds + 1
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    sc._jsc.clearJobGroup()
    assert 0 < jobs[1] <= jobs[0]


def test_a_model_of_over_a_million_rows_is_grown_by_one_task(spark):
    d = spark.range(1_200_000).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.xxhash64("id") % 50).cast("double").alias("y"),
                                      (F.col("id") % 5 > 0).alias("is_train"), (F.col("id") % 5 == 0).alias("is_val"))
    jobs, sc = [], spark.sparkContext
    for rounds in (1, 3):
        sc.setJobGroup(f"many-{rounds}", "")
        assert len(B.fit_many(d, ["a"], [B.Spec("y", 1, rounds=rounds)])[0].errors) == rounds + 1
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"many-{rounds}")))
    sc._jsc.clearJobGroup()
    assert 0 < jobs[1] <= jobs[0]


def test_rows_of_many_small_nodes_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(B, "SMALL", 100_000)                           # the nodes of the last level are small, the others large
    monkeypatch.setattr(B, "WHOLE", 1, raising=False)
    bits = [(F.shiftright("id", i) % 2).cast("double").alias(f"f{i}") for i in range(5)]
    d = spark.range(131_072).select("id", *bits, F.lit(True).alias("is_train"), F.lit(False).alias("is_val")).withColumn(
        "y", sum((1 << i) * F.col(f"f{i}") for i in range(5)))
    m = B.fit_many(d, [f"f{i}" for i in range(5)], [B.Spec("y", 5, 1.0, 0.0, rounds=1)])[0]
    assert sorted(m.trees[0].value + m.base) == pytest.approx(range(32)) and set(m.trees[0].count) == {4096.0}


def test_gathered_rows_have_the_sums_of_both_children(monkeypatch):
    monkeypatch.setattr(B, "JOINT", 16)
    monkeypatch.setattr(B, "PIECE", 100)
    rng = np.random.default_rng(5)
    width = np.array([3, 3, 20, 2, 1, 5])
    bins = np.stack([rng.integers(0, w, 3000) for w in width], 1).astype(np.uint8)
    y, part, offset, cells = rng.normal(size=3000), rng.integers(1, 4, 3000).astype(np.uint8), np.concatenate([[0], np.cumsum(width)[:-1]]), int(width.sum())
    r = B.Gathered(bins, y, part, width, offset)
    g = r.gradients(np.zeros(len(r.bins)))
    node, sums = r.root(3, g, cells)
    at = np.zeros(len(r.bins), np.int64)
    for f, cut, less in (([2], [3], [0]), ([0, -1], [1, 0], [1, 3]), ([5, 1, 2, 3], [2, 0, 9, 0], [0, 3, 4, 7])):
        f, cut, less = map(np.array, (f, cut, less))
        at = 2 * at + np.where(f[at] < 0, False, r.bins[np.arange(len(at)), np.maximum(f[at], 0)] > cut[at])
        node, sums = r.below(node, f, cut, less, g, sums, False)
        assert np.array_equal(node, at)
        want = r.sums(at[r.train], 2 * len(f), g, cells)
        assert np.allclose(sums[0], want[0], atol=1e-12) and np.array_equal(sums[1], want[1])


@pytest.mark.parametrize("depth", [2, 4, 7])
def test_places_of_whole_columns_are_those_of_walked_rows(depth):
    rng = np.random.default_rng(depth)
    bins = rng.integers(0, 9, (B.WALKED + 77, 5)).astype(np.uint8)
    trees = [B.Tree(rng.integers(-1, 5, (1 << depth) - 1), rng.integers(0, 8, (1 << depth) - 1), rng.normal(size=1 << depth), np.ones(1 << depth)) for _ in range(3)]
    for t in trees:
        assert np.array_equal(t.place(np.ascontiguousarray(bins.T)), t.leaf(bins))
    m = B.Model(B.Spec("y", depth, 0.3), [], [], 1.5, B.Packed.of(trees))
    want = np.full(len(bins), 1.5)
    for t in trees:
        want += 0.3 * t.value[t.leaf(bins)]
    assert np.array_equal(m.raw(bins), want)


def test_rows_are_predicted_by_their_own_model(spark, frame, monkeypatch):
    monkeypatch.setattr(B, "ALIKE", 50)
    models = {f"p{i}": m for i, m in enumerate(B.fit_many(frame, FEATURES, [B.Spec("y", 3, rounds=3), B.Spec("z", 2, rounds=4)]))}
    twice = frame.unionAll(frame).withColumn("who", F.concat(F.lit("p"), (F.col("id") % 3).cast("string")))
    both = {r.id: r for r in B.predict(twice, models, ["id"]).collect()}
    got = B.predict(twice, models, ["id", "who"], "who").collect()
    assert len(got) == 1000 and got[0].__fields__ == ["id", "who", "p0", "p1"]
    for r in got:
        assert (r.p0, r.p1) == (both[r.id].p0 if r.who == "p0" else None, both[r.id].p1 if r.who == "p1" else None)


def test_models_are_dealt_over_the_cores():
    specs = [B.Spec("m4", d, r, l2) for d in (4, 5, 6, 7) for r in (0.02, 0.05) for l2 in (2.0, 3.0, 4.0)]
    for cores in (1, 4, 12, 100):
        shares = B.shared_out(specs, cores)
        assert sorted(sum(shares, [])) == list(range(24)) and len(shares) == min(24, cores)
        work = [sum(specs[i].depth for i in x) for x in shares]
        assert max(work) - min(work) <= 3
    assert sorted(map(sorted, B.shared_out([B.Spec("y", train=f"t{i % 2}") for i in range(4)], 1))) == [[0, 2], [1, 3]]


def test_importance_equals_a_plain_walk(frame, rows):
    x, y, _, part = rows
    m = B.fit_many(frame, FEATURES, [B.Spec("y", 3, 0.3, 2.0, rounds=8)])[0]
    binned = np.stack([np.searchsorted(b, x[:, i], "left") for i, b in enumerate(m.borders)], 1)[part > 1]
    total = np.zeros(4)
    for t in m.trees:
        value = m.spec.rate * t.value[t.leaf(binned)]

        def walk(node, at, t=t, value=value):
            if node >= len(t.feature) or not len(at):
                return
            f = t.feature[node]
            right = (binned[at, f] > t.cut[node]) & (f >= 0)
            if f >= 0:
                for side in (at[right], at[~right]):
                    total[f] += len(side) * (value[side].mean() - value[at].mean()) ** 2
            walk(2 * node + 1, at[~right])
            walk(2 * node + 2, at[right])
        walk(0, np.arange(len(binned)))
    assert np.allclose(m.importance, 100 * total / total.sum()) and abs(sum(m.importance) - 100) < 1e-9


def test_models_are_kept_by_content(spark, frame):
    spec = [B.Spec("y", 2, 0.3, rounds=3)]
    first, again = B.fitted(frame, FEATURES, spec)[0], B.fitted(frame, FEATURES, spec)[0]
    assert first.to_json() == again.to_json()
    other = B.fitted(frame.withColumn("y", F.col("y") + F.when(F.col("id") == 7, 1.0).otherwise(0.0)), FEATURES, spec)[0]
    assert other.to_json() != first.to_json()


@pytest.mark.parametrize("small", [1000, 0])
def test_models_reach_the_driver_and_the_tasks_packed(spark, frame, rows, small, monkeypatch):
    monkeypatch.setattr(B, "SMALL", small)                             # trees grown by one task, or level by level
    m = B.fit_many(frame, FEATURES, [B.Spec("y", 7, 0.3, 2.0, rounds=12)])[0]
    numbers = len(m.trees) * (4 * (1 << 7) - 2)
    assert 0 < numbers and len(pickle.dumps(m)) < 4 * numbers and len(m.to_json()) < 4 * numbers
    plain = B.Model(m.spec, m.features, m.borders, m.base, [B.Tree(*map(np.array, (t.feature, t.cut, t.value, t.count))) for t in m.trees], m.errors, m.importance)
    again = B.Model.from_json(plain.to_json())
    bins = np.stack([np.searchsorted(b, rows[0][:, i], "left") for i, b in enumerate(m.borders)], 1).astype(np.uint8)
    assert again.to_json() == m.to_json() and np.array_equal(again.raw(bins), plain.raw(bins)) and B.importance(again) == m.importance


def test_the_digest_of_many_rows_does_not_overflow(spark, monkeypatch):
    monkeypatch.setattr(B, "fit_many", lambda *a: [])
    d = spark.range(24_000_000).select("id", F.lit(1.0).alias("y"), F.lit(True).alias("is_train"), F.lit(False).alias("is_val"))
    assert B.fitted(d, [], [B.Spec("y")]) == []


def test_empty_and_odd_tables(spark, frame):
    m = B.fit_many(frame.limit(0), FEATURES, [B.Spec("y", 2, rounds=3)])[0]
    assert m.trees == [] and m.base == 0.0
    odd = frame.withColumn("y", F.when(F.col("id") % 3 != 0, F.col("y"))).withColumn("c", F.when(F.col("id") % 2 == 0, F.col("c")))
    m = B.fit_many(odd, FEATURES, [B.Spec("y", 2, rounds=3)])[0]
    assert 0 < len(m.trees) <= 3 and B.predict(odd, {"p": m}).filter("p is null").count() == 0


def test_the_grids_are_the_reference_s():
    p = inspect.signature(ML.grid_search).parameters
    assert p["depths"].default == (5, 6, 7, 8) and p["rates"].default == (0.03, 0.05, 0.07) and p["l2s"].default == (3.0,)
    assert B.Spec("y").patience == 50 and B.Spec("y").rounds == 1000 and len(ML.TRIAL_FEATURES) == 36


def test_seeded_noise_has_its_mean_and_deviation(spark):
    d = spark.range(20_000)
    for k, (mean, sd) in R.TARGET_NOISE.items():
        r = d.agg(F.avg(R.gauss(F.col("id"), k, mean, sd)).alias("m"), F.stddev(R.gauss(F.col("id"), k, mean, sd)).alias("s")).first()
        assert abs(r.m - mean) < 4 * sd / 20_000**0.5 and abs(r.s - sd) < 0.03 * sd
    a = {r.id: r.x for r in d.limit(50).select("id", R.gauss(F.col("id"), "v1").alias("x")).collect()}
    b = {r.id: r.x for r in d.repartition(7).filter("id < 50").select("id", R.gauss(F.col("id"), "v1").alias("x")).collect()}
    assert all(a[k] == b[k] for k in a)


def test_resampling_draws_about_the_target(spark):
    for n in (300, 5000):
        h = spark.range(n).select("id", F.lit(60.0).alias("dur"), F.lit(50.0).alias("impact_score"))
        e = FC.resampled_training_set(h)
        total, distinct = e.count(), e.select("id").distinct().count()
        assert abs(total - 1000) < 4 * 1000**0.5 and distinct < total
        assert abs(distinct - n * (1 - np.exp(-1000 / n))) < 60
    assert FC.resampled_training_set(h.limit(0)).count() == 0
