"""Clustering, feature, model and what-if queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import clustering as CL
from ..operators import evidence as EV
from ..operators import ml as ML
from ..operators import scoring as SC
from ..session import written
from ..sources import fixtures as X
from ..sources.tables import read_table
from .q_scoring import BASELINE_SQL, BLEND_SQL, CLASS, EVIDENCE_SQL
from .oracle import GEO_SQL
from .q_basic import _INTENSITY_SQL, _WEIGHT_SQL
from .registry import query

EPS_SQL = "CAST(0.01 AS DOUBLE)"


@query("neighbour_counts", f"""
WITH p AS (SELECT latitude AS lat, longitude AS lon, count(*) AS w FROM inc
           WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY latitude, longitude),
n AS (SELECT a.lat, a.lon, CAST(sum(b.w) AS BIGINT) AS neighbour_count FROM p a JOIN p b
      ON sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) <= {EPS_SQL}
      GROUP BY a.lat, a.lon)
SELECT i.id, n.neighbour_count, n.neighbour_count >= 5 AS is_core FROM inc i
LEFT JOIN n ON i.latitude = n.lat AND i.longitude = n.lon""")
def q_neighbour_counts(spark, sf):
    """J07 / L09 core flags: rows within eps = 0.01° (self included) via the grid equi-join."""
    d = X.inc(spark, sf).select("id", "latitude", "longitude")
    return CL.neighbour_counts(d).select("id", "neighbour_count", "is_core")


@query("geo_clusters", f"WITH RECURSIVE {GEO_SQL} SELECT id, geo_cluster FROM geo")
def q_geo_clusters(spark, sf):
    """Density clusters."""
    return CL.dbscan(X.inc(spark, sf).select("id", "latitude", "longitude"))


FV_SQL = """
fv AS (SELECT i.*,
  CAST(dense_rank() OVER (ORDER BY coalesce(event_cause, 'others')) - 1 AS INT) AS event_cause_encoded,
  CAST(dense_rank() OVER (ORDER BY coalesce(event_type, 'unknown')) - 1 AS INT) AS event_type_encoded,
  CAST(dense_rank() OVER (ORDER BY coalesce(veh_type, 'unknown')) - 1 AS INT) AS veh_type_encoded,
  CASE WHEN corridor_tier > 0 THEN 1 ELSE 0 END AS is_corridor,
  CAST(CASE WHEN latitude IS NULL THEN 0 WHEN la1 = la0 THEN 4
       ELSE least(greatest(ceil((latitude - la0) / (la1 - la0) * 10) - 1, 0), 9) END AS INT) AS lat_bin,
  CAST(CASE WHEN longitude IS NULL THEN 0 WHEN lo1 = lo0 THEN 4
       ELSE least(greatest(ceil((longitude - lo0) / (lo1 - lo0) * 10) - 1, 0), 9) END AS INT) AS lon_bin,
  CASE WHEN weekday >= 5 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN hour < 6 OR hour > 22 THEN 1 ELSE 0 END AS is_night,
  sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
  sin(2 * pi() * weekday / 7) AS weekday_sin, cos(2 * pi() * weekday / 7) AS weekday_cos,
  sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos,
  CAST(CASE WHEN k % 3 = 0 THEN 'yes' ELSE 'no' END = 'yes' AS INT) AS authenticated,
  coalesce(CASE WHEN police_station IS NULL THEN NULL
       ELSE row_number() OVER (PARTITION BY police_station ORDER BY start_datetime, id) - 1 END, 0) AS station_event_count,
  coalesce(CASE WHEN junction IS NULL THEN NULL
       ELSE row_number() OVER (PARTITION BY junction ORDER BY start_datetime, id) - 1 END, 0) AS junction_event_count,
  row_number() OVER (PARTITION BY corridor ORDER BY start_datetime, id) - 1 AS corridor_event_count
FROM (SELECT inc.*, geo.geo_cluster FROM inc JOIN geo USING (id)) i CROSS JOIN (SELECT min(latitude) la0, max(latitude) la1, min(longitude) lo0, max(longitude) lo1 FROM inc) m)"""


@query("feature_vector", f"WITH RECURSIVE {GEO_SQL}, {FV_SQL} SELECT id, " + ", ".join(ML.SERVED_FEATURES) + " FROM fv")
def q_feature_vector(spark, sf):
    """The 26 served feature columns."""
    return _features(X.inc(spark, sf)).select("id", *ML.SERVED_FEATURES)


def _features(d):
    return ML.feature_table(d.withColumn("authenticated", F.when(F.col("k") % 3 == 0, "yes").otherwise("no")),
                            CL.dbscan(d.select("id", "latitude", "longitude")))


def _train_frame(spark, sf):
    """The assembled feature table of the scored incidents, evaluated once and written (S05): fits, folds and metrics
    read the columns back instead of running the feature lineage again."""
    d = ML.split(_features(X.scored(spark, sf)))
    keep = ["id", "event_cause", "impact_score", "split", "is_val", "is_train", *ML.SERVED_FEATURES]
    return written(d.select(*keep), "features")


def _trial_frame(spark, sf):
    """The 36 features of the best trial and the six noisy targets; an incident's description is the document of its id."""
    from .q_basic import noisy_targets
    from .q_quality import _end
    text = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    d = X.inc(spark, sf).join(text, "id", "left").withColumns({"endlatitude": _end("latitude"), "endlongitude": _end("longitude")})
    return written(ML.split(ML.trial_features(d).join(noisy_targets(spark, sf), "id")), "trial")


_FEATS = ML.SERVED_FEATURES


def _impact_model(d):
    return B.fitted(d, _FEATS, [B.Spec("impact_score")])[0]


@query("gbt_impact_model")
def q_gbt_impact_model(spark, sf):
    """L01 + M02 + L03: boosting on the served features (early stopping on a validation slice); train/test metrics."""
    d = _train_frame(spark, sf)
    return ML.metrics(ML.score(d, _impact_model(d), "impact_score"), "impact_score")


@query("model_scores")
def q_model_scores(spark, sf):
    """Clipped model score, class and raw output for every test incident."""
    d = _train_frame(spark, sf)
    return ML.score(d.filter(F.col("split") == "test"), _impact_model(d), "impact_score")


@query("gbt_grid_search")
def q_gbt_grid_search(spark, sf):
    """The 12-point depth × rate grid on the hash split; the best point by test R² is marked."""
    return ML.grid_search(_train_frame(spark, sf), _FEATS, "impact_score")


@query("gbt_grid_search_l2")
def q_gbt_grid_search_l2(spark, sf):
    """The 48-point depth × rate × l2 grid on the 36 features of the best trial and its noisy target m4."""
    return ML.grid_search(_trial_frame(spark, sf), ML.TRIAL_FEATURES, "m4", (4, 5, 6, 7), (0.02, 0.03, 0.04, 0.05), (2.0, 3.0, 4.0), 1200)


TRIAL_SQL = """
tf AS (SELECT i.id,
  CAST(corridor_tier AS DOUBLE) AS corridor_tier, CAST(requires_road_closure AS DOUBLE) AS c, CAST(hour AS DOUBLE) AS hour, CAST(weekday AS DOUBLE) AS weekday,
  CASE WHEN hour IN (7, 8, 9, 17, 18, 19) THEN 1.0::DOUBLE ELSE 0 END AS is_peak, CASE WHEN weekday >= 5 THEN 1.0::DOUBLE ELSE 0 END AS is_weekend,
  CASE WHEN hour >= 22 OR hour <= 5 THEN 1.0::DOUBLE ELSE 0 END AS is_night, CASE WHEN hour <= 3 OR hour >= 22 THEN 1.0::DOUBLE ELSE 0 END AS is_extreme_hour,
  CASE WHEN regexp_matches(coalesce(d.text, ''), '[\u0C80-\u0CFF]') THEN 1.0::DOUBLE ELSE 0 END AS has_kannada,
  CAST(coalesce(length(d.text), 0) AS DOUBLE) AS desc_length, {intensity}::DOUBLE AS traffic_intensity, {weight}::DOUBLE AS weekday_weight,
  CASE WHEN k % 4 = 0 THEN 0.0::DOUBLE ELSE 1 END AS has_end_coords,
  CASE WHEN k % 4 <> 1 AND latitude IS NOT NULL AND longitude IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS coords_complete
  FROM inc i LEFT JOIN documents d ON i.id = d.doc_id)"""


@query("trial_features", "WITH " + TRIAL_SQL.format(intensity=_INTENSITY_SQL, weight=_WEIGHT_SQL) + """
SELECT id, corridor_tier, c AS requires_road_closure, hour, weekday, is_peak, is_weekend, is_night, is_extreme_hour, has_kannada, desc_length,
  traffic_intensity, weekday_weight, round(traffic_intensity * weekday_weight, 6) AS temporal_score, has_end_coords, coords_complete,
  abs(hour - 12) AS hour_deviation, c * corridor_tier AS closure_tier, is_peak * corridor_tier AS peak_tier, is_weekend * corridor_tier AS weekend_tier,
  c * is_peak AS closure_peak, corridor_tier * corridor_tier AS tier_squared, c * is_peak * corridor_tier AS closure_peak_tier,
  has_kannada * corridor_tier AS kannada_tier, round(traffic_intensity * corridor_tier, 6) AS intensity_tier,
  round(c * corridor_tier * traffic_intensity * weekday_weight, 6) AS closure_tier_temporal,
  round(corridor_tier * traffic_intensity * weekday_weight, 6) AS tier_temporal, CASE WHEN corridor_tier > 0 THEN 1.0::DOUBLE ELSE 0 END AS is_corridor
FROM tf""")
def q_trial_features(spark, sf):
    """Of the 36 features of the best trial those that no other query checks, products rounded to six digits."""
    from .q_quality import _end
    text = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    d = X.inc(spark, sf).join(text, "id", "left").withColumns({"endlatitude": _end("latitude"), "endlongitude": _end("longitude")})
    rounded = {"temporal_score", "intensity_tier", "closure_tier_temporal", "tier_temporal"}
    other = {"event_cause_encoded", "veh_type_encoded", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "closure_temporal", "desc_word_count", "cause_cluster"}
    return ML.trial_features(d).select("id", *[F.round(x, 6).alias(x) if x in rounded else F.col(x) for x in ML.TRIAL_FEATURES if x not in other])


@query("feature_importance")
def q_feature_importance(spark, sf):
    """Top-15 features of the impact model by prediction change."""
    return ML.feature_importance(spark, _impact_model(_train_frame(spark, sf)))


@query("model_comparison")
def q_model_comparison(spark, sf):
    """Test metrics of the boosted model vs the rule baseline (M03) for the v2 label; best first."""
    d = _train_frame(spark, sf)
    test = d.filter(F.col("split") == "test")
    gbt = ML.metrics(ML.score(test, _impact_model(d), "impact_score"), "impact_score").withColumn("model", F.lit("gbt"))
    base, _ = SC.operational_baseline(F.col("event_cause"), F.col("corridor_tier"), F.col("requires_road_closure"),
                                      F.col("hour"))
    rule = ML.metrics(test.withColumn("impact_score_pred", base.cast("double")), "impact_score").withColumn(
        "model", F.lit("rule_baseline"))
    allm = gbt.unionByName(rule)
    from pyspark.sql import Window
    w = Window.partitionBy()                                   # two rows
    return (allm.withColumn("best_model", F.max_by("model", "r2").over(w))
            .withColumn("improvement_r2", F.max("r2").over(w) - F.min("r2").over(w)).orderBy(F.desc("r2")))


@query("target_comparison")
def q_target_comparison(spark, sf):
    """One model on each of the six noisy trial targets, 36 features; test R², MAE and RMSE, best first."""
    return ML.compare_targets(_trial_frame(spark, sf), ML.TRIAL_FEATURES, ["v1", "v2", "v3", "m4", "m5", "m6"])


@query("cross_validation")
def q_cross_validation(spark, sf):
    """5-fold CV with an md5 fold column."""
    return ML.cross_validate(_train_frame(spark, sf), _FEATS, "impact_score")


@query("embedding_pca")
def q_embedding_pca(spark, sf):
    """PCA of the given vectors to 32 dimensions."""
    return ML.pca(read_table(spark, sf, "embeddings"), 32)


@query("event_training_set", """
SELECT i.id, c.expected_crowd,
  CASE WHEN c.expected_crowd <= 10000 THEN 0 WHEN c.expected_crowd <= 30000 THEN 1 WHEN c.expected_crowd <= 50000 THEN 2 ELSE 3 END AS crowd_tier,
  least(100.0, s.impact_score + 5 * CASE WHEN c.expected_crowd <= 10000 THEN 0 WHEN c.expected_crowd <= 30000 THEN 1
        WHEN c.expected_crowd <= 50000 THEN 2 ELSE 3 END) AS target
FROM inc i JOIN scored s ON i.id = s.id CROSS JOIN (VALUES (5000), (20000), (40000), (80000)) c(expected_crowd)
WHERE i.event_type = 'planned'""")
def q_event_training_set(spark, sf):
    """L12 (definition ours): planned history expanded over four crowd levels (deterministic, no resampling)."""
    from ..functions.rules import crowd_tier
    s = X.scored(spark, sf).filter(F.col("event_type") == "planned")
    e = s.select("id", "impact_score", F.explode(F.array(*[F.lit(c) for c in (5000, 20000, 40000, 80000)])).alias("expected_crowd"))
    t = crowd_tier(F.col("expected_crowd"))
    return e.select("id", "expected_crowd", t.alias("crowd_tier"),
                    F.least(F.lit(100.0), F.col("impact_score") + 5 * t).alias("target"))


def _uniform_sql(stream: str, key: str) -> str:
    return f"((CAST('0x' || substr(md5('{stream}:' || {key}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)"


_DRAWS_SQL = " + ".join("CASE WHEN u >= " + " + ".join(f"exp(-rate) * pow(rate, {i}) / {math.factorial(i)}" for i in range(k + 1)) + " THEN 1 ELSE 0 END"
                        for k in range(20))


@query("event_training_resampled", f"""
WITH m AS (SELECT greatest(count(*), 1) AS n FROM scored),
s AS (SELECT id, dur, impact_score, n, CAST(greatest(1, ceil(1000.0::DOUBLE / n)) AS INT) AS reps FROM scored CROSS JOIN m WHERE id IS NOT NULL),
r AS (SELECT *, CAST(unnest(range(0, reps)) AS INT) AS replicate FROM s),
d AS (SELECT *, 1000.0::DOUBLE / n / reps AS rate, {_uniform_sql('draw', "replicate || '/' || id")} AS u FROM r),
w AS (SELECT *, {_DRAWS_SQL} AS weight FROM d),
c AS (SELECT *, CAST(unnest(range(1, CAST(weight AS BIGINT) + 1)) AS INT) AS copy FROM w WHERE weight > 0),
x AS (SELECT *, CAST(floor({_uniform_sql('crowd', "replicate || '/' || id || '/' || copy")} * 80000) AS INT) AS expected_crowd FROM c),
t AS (SELECT *, CASE WHEN expected_crowd <= 10000 THEN 0 WHEN expected_crowd <= 30000 THEN 1 WHEN expected_crowd <= 50000 THEN 2 ELSE 3 END AS crowd_tier FROM x)
SELECT id, replicate, copy, expected_crowd, crowd_tier, 1 + expected_crowd / 100000 AS crowd_factor,
  dur * (1 + expected_crowd / 100000) AS resolution_minutes, least(100.0, impact_score + 5 * crowd_tier) AS target FROM t""")
def q_event_training_resampled(spark, sf):
    """About 1,000 synthetic planned events, drawn from all incidents with replacement."""
    from ..operators.forecast import resampled_training_set
    return resampled_training_set(X.scored(spark, sf))


_VARIANT_SQL = """
base AS (SELECT id AS request_id, event_cause AS cause, corridor, corridor_tier AS tier, requires_road_closure AS closure,
           hour, weekday FROM inc),
req AS (
  SELECT *, 'base' AS variant FROM base
  UNION ALL SELECT request_id, cause, corridor, tier, 1 - closure, hour, weekday, 'closure_toggle' FROM base
  UNION ALL SELECT request_id, cause, 'Non-corridor', 0, closure, hour, weekday, 'non_corridor' FROM base WHERE corridor <> 'Non-corridor'
  UNION ALL SELECT request_id, cause, 'C0', 1, closure, hour, weekday, 'tier1_corridor' FROM base WHERE corridor <> 'C0'
  UNION ALL SELECT request_id, cause, corridor, tier, closure, 9, weekday, 'hour_9' FROM base WHERE hour <> 9
  UNION ALL SELECT request_id, cause, corridor, tier, closure, 2, weekday, 'hour_2' FROM base WHERE hour <> 2
  UNION ALL SELECT request_id, cause, corridor, tier, closure, hour, CASE WHEN weekday < 5 THEN 5 ELSE 2 END, 'weekday_toggle' FROM base)"""


@query("what_if", f"""
WITH {_VARIANT_SQL}, {EVIDENCE_SQL},
s AS (SELECT *, CAST({BASELINE_SQL} AS DOUBLE) AS bs FROM evf),
b AS (SELECT request_id, variant, {BLEND_SQL} AS final_score FROM s),
o AS (SELECT *, max(CASE WHEN variant = 'base' THEN final_score END) OVER (PARTITION BY request_id) AS base_score FROM b)
SELECT request_id, variant, final_score AS variant_score, {CLASS.format(s='final_score')} AS variant_class,
  final_score - base_score AS delta
FROM o WHERE variant <> 'base'""")
def q_what_if(spark, sf):
    """Up to six counterfactual variants per incident, no-ops skipped, rescored with M04, delta vs base."""
    from .q_scoring import requests
    r = requests(spark, sf).select("request_id", "cause", "corridor", "tier", "closure", "hour", "weekday")
    out = SC.what_if(r, X.scored(spark, sf), "C0")
    return out
