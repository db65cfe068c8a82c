"""Model features, training and evaluation.

Splits are md5 buckets of the row id (deterministic under any partitioning, unlike ``randomSplit``). Models are those
of ``boosting``: all points of a grid, all folds and all targets grow together. The reference's gradient-boosting
library and frozen models are not available, so accuracy numbers are not those it has published.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encoding as E
from ..functions import temporal as T
from ..functions import rules as R
from ..functions import text as G
from ..functions.rules import clip, risk_class
from . import boosting as B
from .stats import equal_width_bin
from .windows import prior_count

# FIXED VALUES: the names of the served features, and of the features of the best trial.
SERVED_FEATURES = [
    "event_cause_encoded", "event_type_encoded", "veh_type_encoded",
    "corridor_tier", "is_corridor", "geo_cluster",
    "latitude", "longitude", "lat_bin", "lon_bin",
    "hour", "weekday", "month", "is_weekend", "is_night",
    "hour_sin", "hour_cos", "weekday_sin", "weekday_cos",
    "month_sin", "month_cos",
    "requires_road_closure", "authenticated",
    "station_event_count", "junction_event_count", "corridor_event_count",
]
TRIAL_FEATURES = [
    "event_cause_encoded", "veh_type_encoded", "corridor_tier", "is_corridor", "hour", "weekday", "is_weekend", "is_night", "is_peak",
    "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "requires_road_closure", "traffic_intensity", "weekday_weight", "temporal_score",
    "closure_tier", "peak_tier", "weekend_tier", "closure_peak", "closure_temporal", "tier_squared", "tier_temporal", "has_kannada",
    "desc_length", "desc_word_count", "cause_cluster", "has_end_coords", "coords_complete", "hour_deviation", "is_extreme_hour",
    "closure_tier_temporal", "closure_peak_tier", "kannada_tier", "intensity_tier",
]


def bucket(id_col: str = "id", salt: str = "42"):
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(id_col).cast("string"))), 1, 8), 16, 10)
                  .cast("long"), F.lit(100))


def feature_table(df: DataFrame, geo_cluster: DataFrame) -> DataFrame:
    """The 26 served features for every incident (NULL → 0 as the training scripts do). ``df`` carries the cleaned
    incident columns, with ``authenticated`` as text and ``junction``; ``geo_cluster`` is (id, geo_cluster)."""
    d = E.label_encode(df, {"event_cause_encoded": ("event_cause", "others"), "event_type_encoded": ("event_type", "unknown"),
                            "veh_type_encoded": ("veh_type", "unknown")})
    d = equal_width_bin(d, "latitude", "lat_bin")
    d = equal_width_bin(d, "longitude", "lon_bin")
    for key, out in (("police_station", "station_event_count"), ("junction", "junction_event_count"), ("corridor", "corridor_event_count")):
        d = prior_count(d, key, out)
    d = d.join(geo_cluster, "id", "left").withColumn("authenticated", (F.col("authenticated") == "yes").cast("int"))
    cols = {}
    for c, p in (("hour", 24), ("weekday", 7), ("month", 12)):
        s, co = T.cyclical(F.col(c), p)
        cols[f"{c}_sin"], cols[f"{c}_cos"] = s, co
    d = d.select(
        "*", F.when(F.col("corridor_tier") > 0, 1).otherwise(0).alias("is_corridor"),
        T.is_weekend(F.col("weekday")).alias("is_weekend"), T.is_night(F.col("hour"), "code").alias("is_night"),
        *[v.alias(k) for k, v in cols.items()])
    return d.fillna(0, subset=[c for c in SERVED_FEATURES if c != "geo_cluster"]).fillna(-1, subset=["geo_cluster"])


def trial_features(df: DataFrame) -> DataFrame:
    """``id`` and the 36 features of the best trial. ``df`` carries the cleaned incident columns, the description as
    ``text`` (null: empty) and the end point as ``endlatitude``, ``endlongitude``. Codes are first-appearance ones (E02)."""
    d = E.appearance_encode(df, "event_cause", "event_cause_encoded", ["start_datetime", "id"])
    d = d.withColumn("__veh", F.coalesce("veh_type", F.lit("Others")))
    d = E.appearance_encode(d, "__veh", "veh_type_encoded", ["start_datetime", "id"])
    hour, day, c, t = F.col("hour"), F.col("weekday"), F.col("requires_road_closure"), F.col("corridor_tier")
    (hs, hc), (ws, wc) = T.cyclical(hour, 24), T.cyclical(day, 7)
    has_end, complete = R.data_quality_flags(F.col("endlatitude"), F.col("endlongitude"), F.col("latitude"), F.col("longitude"))
    d = d.select("id", "event_cause_encoded", "veh_type_encoded", "corridor_tier", "hour", "weekday", "requires_road_closure",
                 (t > 0).cast("int").alias("is_corridor"), T.is_weekend(day).alias("is_weekend"),
                 ((hour >= 22) | (hour <= 5)).cast("int").alias("is_night"), T.is_peak(hour, "code").alias("is_peak"),
                 hs.alias("hour_sin"), hc.alias("hour_cos"), ws.alias("weekday_sin"), wc.alias("weekday_cos"),
                 T.traffic_intensity(hour).alias("traffic_intensity"), T.weekday_weight(day).alias("weekday_weight"),
                 T.temporal_score(hour, day).alias("temporal_score"), G.has_script(F.coalesce("text", F.lit(""))).alias("has_kannada"),
                 F.coalesce(F.length("text"), F.lit(0)).alias("desc_length"),
                 F.coalesce(G.word_count(F.col("text")), F.lit(0)).alias("desc_word_count"), R.cause_cluster(F.col("event_cause")).alias("cause_cluster"),
                 has_end.alias("has_end_coords"), complete.alias("coords_complete"), T.hour_deviation(hour).alias("hour_deviation"),
                 T.is_extreme_hour(hour).alias("is_extreme_hour"))
    peak, ts = F.col("is_peak"), F.col("temporal_score")
    d = d.withColumns({"closure_tier": c * t, "peak_tier": peak * t, "weekend_tier": F.col("is_weekend") * t, "closure_peak": c * peak,
                       "closure_temporal": c * ts, "tier_squared": t * t, "tier_temporal": t * ts, "closure_tier_temporal": c * t * ts,
                       "closure_peak_tier": c * peak * t, "kannada_tier": F.col("has_kannada") * t, "intensity_tier": F.col("traffic_intensity") * t})
    return d.select("id", *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in TRIAL_FEATURES])


def split(df: DataFrame, id_col: str = "id") -> DataFrame:
    """80/20 test split; of the training part a tenth of all rows is the validation slice for early stopping."""
    b = bucket(id_col)
    return df.withColumn("split", F.when(b < 20, "test").otherwise("train")).withColumn("is_val", (b >= 20) & (b < 30)).withColumn("is_train", b >= 30)


def score(df: DataFrame, model: B.Model, label: str) -> DataFrame:
    """Model score clipped to 0–100 with its class and the raw output."""
    p = B.predict(df, {"prediction": model}, ["id", label, "split"])
    return p.select("id", label, F.col("prediction").alias("raw_model_output"),
                    clip(F.col("prediction"), 0.0, 100.0).alias("impact_score_pred"),
                    risk_class(clip(F.col("prediction"), 0.0, 100.0)).alias("risk_class_pred"), "split")


def metrics(pred: DataFrame, label: str, pred_col: str = "impact_score_pred") -> DataFrame:
    """Per split n, R², MAE, RMSE from sums (one aggregate)."""
    e = F.col(label) - F.col(pred_col)
    g = pred.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
                                  F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("__ssr"),
                                  F.var_pop(label).alias("__v"))
    return g.select("split", "n", (1 - F.col("__ssr") / (F.col("__v") * F.col("n"))).alias("r2"), "mae", "rmse")


def metrics_of_many(df: DataFrame, models: dict[str, B.Model], part: Column, own: Column | None = None) -> list:
    """L03 for many models in one pass: one row per value of ``part`` (null ones left out), with n, r2, mae and rmse of
    each model as ``<name>_n`` and so on; predictions clipped to 0–100. With ``own``, the name of a row's model, a model is
    measured on its own rows alone."""
    used = ["__part", *(["__own"] if own is not None else []), *sorted({m.spec.label for m in models.values()})]
    d = df.withColumn("__part", part).withColumn("__own", F.lit(None) if own is None else own).filter("__part is not null")
    p = B.predict(d, models, used, None if own is None else "__own")
    aggs = []
    for name, m in models.items():
        y = F.col(m.spec.label) if own is None else F.when(F.col("__own") == name, F.col(m.spec.label))
        e = y - clip(F.col(name), 0.0, 100.0)
        ssr, n = F.sum(e * e), F.count(y)
        aggs += [n.alias(f"{name}_n"), (1 - ssr / (F.var_pop(y) * n)).alias(f"{name}_r2"), F.avg(F.abs(e)).alias(f"{name}_mae"),
                 F.sqrt(F.avg(e * e)).alias(f"{name}_rmse")]
    return p.groupBy("__part").agg(*aggs).collect()                              # a row a part


def grid_search(df: DataFrame, features: list[str], label: str, depths=(5, 6, 7, 8), rates=(0.03, 0.05, 0.07), l2s=(3.0,),
                rounds: int = 1000) -> DataFrame:
    """Depth × rate × l2 grid, by default the reference's first. All points grow together on the train rows,
    each with its own early stopping on the validation slice, and are judged there and on the test rows; ``best`` marks
    the point of highest test R²."""
    specs = [B.Spec(label, d, r, float(l2), rounds=rounds) for d in depths for r in rates for l2 in l2s]
    models = {f"grid_point_{i}": m for i, m in enumerate(B.fitted(df, features, specs))}
    part = F.when(F.col("split") == "test", "test").when(F.col("is_val"), "validation")
    got = {r["__part"]: r for r in metrics_of_many(df, models, part)}

    def r2(part, name):
        v = got[part][f"{name}_r2"] if part in got else None
        return float(v) if v is not None else float("nan")

    rows = [(m.spec.depth, m.spec.rate, m.spec.l2, len(m.errors) - 1, len(m.trees), r2("validation", n), r2("test", n)) for n, m in models.items()]
    top = max(rows, key=lambda r: (r[6], -r[0], -r[1], -r[2]))
    return df.sparkSession.createDataFrame([(*r, r == top) for r in rows], "max_depth int, learning_rate double, l2 double, rounds int, trees int, "
                                           "validation_r2 double, test_r2 double, best boolean")


def compare_targets(df: DataFrame, features: list[str], targets: list[str], depth: int = 6, rounds: int = 1200) -> DataFrame:
    """One model per trial target on the same features and split, grown together; test metrics, best R² first."""
    models = dict(zip(targets, B.fitted(df, features, [B.Spec(t, depth, rounds=rounds) for t in targets])))
    named = {f"p_{t}": m for t, m in models.items()}
    got = {r["__part"]: r for r in metrics_of_many(df, named, F.col("split"))}
    rows = [(t, int(got["test"][f"p_{t}_n"]), len(m.trees), float(got["train"][f"p_{t}_r2"]), float(got["test"][f"p_{t}_r2"]),
             float(got["test"][f"p_{t}_mae"]), float(got["test"][f"p_{t}_rmse"])) for t, m in models.items()]
    rows.sort(key=lambda r: (-r[4], r[0]))
    return df.sparkSession.createDataFrame([(*r, i == 0) for i, r in enumerate(rows)], "target string, n long, trees int, train_r2 double, "
                                           "r2 double, mae double, rmse double, best boolean")


def cross_validate(df: DataFrame, features: list[str], label: str, folds: int = 5) -> DataFrame:
    """K-fold CV with deterministic folds (md5 bucket mod k); the folds' models grow together, and each stops early
    on a tenth of its own training rows."""
    fold, val = (bucket() % folds).cast("int"), bucket(salt="cv") < 10
    d = df.select("*", fold.alias("fold")).withColumns({f"train_{k}": (F.col("fold") != k) & ~val for k in range(folds)} |
                                                       {f"val_{k}": (F.col("fold") != k) & val for k in range(folds)})
    specs = [B.Spec(label, train=f"train_{k}", val=f"val_{k}") for k in range(folds)]
    models = {f"fold_model_{k}": m for k, m in enumerate(B.fitted(d, features, specs))}
    got = {r["__part"]: r for r in metrics_of_many(d, models, F.col("fold"), F.concat(F.lit("fold_model_"), F.col("fold").cast("string")))}
    r2 = [float(got[k][f"fold_model_{k}_r2"]) for k in sorted(got) if got[k][f"fold_model_{k}_r2"] is not None]
    mean = sum(r2) / max(len(r2), 1)
    return df.sparkSession.createDataFrame([(folds, mean, (sum((x - mean) ** 2 for x in r2) / max(len(r2), 1)) ** 0.5)],
                                           "folds int, mean_r2 double, std_r2 double")


def feature_importance(spark, model: B.Model, top: int = 15) -> DataFrame:
    """The ``top`` features by prediction change, in per cent of all (model metadata, not data)."""
    rows = sorted(zip(model.features, model.importance), key=lambda t: (-t[1], t[0]))[:top]
    return spark.createDataFrame([(f, float(x)) for f, x in rows], "feature string, importance double")


def pca(df: DataFrame, k: int = 32, col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """PCA of array<float> vectors to k dimensions (the d×d covariance is bounded by the dimension d)."""
    d = df.select(id_col, array_to_vector(F.col(col)).alias("v"))
    m = PCA(k=k, inputCol="v", outputCol="p").fit(d)
    return m.transform(d).select(id_col, vector_to_array("p").alias("pca"))
