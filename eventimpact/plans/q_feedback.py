"""Feedback-loop and model-metric queries (M22–M26, J11, U01, L03–L06) over the ``plog`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as FB
from ..sources import fixtures as X
from ..sources.tables import read_table
from .registry import query

CLS = """CASE WHEN {s} >= 75 THEN 'Critical' WHEN {s} >= 50 THEN 'High' WHEN {s} >= 25 THEN 'Medium' ELSE 'Low' END"""
LOG_SQL = f"""
lg AS (SELECT *, {CLS.format(s='predicted_impact')} AS predicted_class,
  CASE WHEN actual_impact IS NOT NULL THEN {CLS.format(s='actual_impact')} END AS actual_class,
  CASE WHEN predicted_impact <> 0 AND actual_impact <> 0 THEN abs(predicted_impact - actual_impact) END AS error_abs,
  CASE WHEN predicted_impact <> 0 AND actual_impact <> 0 THEN
    CASE WHEN actual_impact > 0 THEN abs(predicted_impact - actual_impact) / actual_impact * 100 ELSE 0 END END AS error_pct,
  CASE WHEN predicted_impact <> 0 AND actual_impact <> 0 THEN
    {CLS.format(s='predicted_impact')} = {CLS.format(s='actual_impact')} END AS class_correct
FROM plog)"""
DRIFT_NOW = "1998-08-01 00:00:00"


def _log(spark, sf):
    return FB.with_errors(X.plog(spark, sf))


@query("prediction_errors", f"""
WITH {LOG_SQL}
SELECT prediction_id, predicted_class, actual_class, error_abs, error_pct, class_correct FROM lg""")
def q_prediction_errors(spark, sf):
    """Errors skip zero or missing predictions and outcomes."""
    return _log(spark, sf).select("prediction_id", "predicted_class", "actual_class", "error_abs", "error_pct",
                                  "class_correct")


@query("log_append", """
SELECT CAST(prediction_id AS VARCHAR) AS prediction_id, ts, cause, corridor, closure, hour, predicted_impact, actual_impact, 'log' AS source FROM plog
UNION ALL
SELECT 'INC_' || CAST(id AS VARCHAR), CAST(start_datetime AS TIMESTAMP), event_cause, corridor, requires_road_closure, hour,
  impact_score, NULL, 'new' FROM scored""")
def q_log_append(spark, sf):
    """New predictions (every scored incident) appended to the log by name; absent columns are NULL."""
    log = X.plog(spark, sf).select(F.col("prediction_id").cast("string").alias("prediction_id"),
                                   F.col("ts").cast("timestamp").alias("ts"), "cause", "corridor", "closure", "hour",
                                   "predicted_impact", "actual_impact", F.lit("log").alias("source"))
    new = X.scored(spark, sf).select(F.concat(F.lit("INC_"), F.col("id").cast("string")).alias("prediction_id"),
                                     F.col("start_datetime").cast("timestamp").alias("ts"),
                                     F.col("event_cause").alias("cause"), "corridor",
                                     F.col("requires_road_closure").alias("closure"), "hour",
                                     F.col("impact_score").alias("predicted_impact"), F.lit("new").alias("source"))
    return log.unionByName(new, allowMissingColumns=True)


OUTCOME_SQL = """
pr AS (SELECT o_orderkey AS prediction_id, 10 + (o_orderkey * 7919 % 9000) / CAST(100 AS DOUBLE) AS predicted_impact
       FROM orders WHERE o_orderstatus <> 'P'),
oc AS (SELECT l_orderkey AS prediction_id, l_linenumber AS line, l_shipdate AS reported_at,
         least(100, greatest(0, 10 + (l_orderkey * 7919 % 9000) / CAST(100 AS DOUBLE) + (l_discount - 0.05) * 200)) AS actual_impact
       FROM lineitem),
fo AS (SELECT prediction_id, arg_min(actual_impact, (reported_at, line, actual_impact)) AS actual_impact,
         min(reported_at) AS reported_at FROM oc GROUP BY prediction_id)"""


def _predictions(spark, sf):
    o = read_table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P")
    return o.select(F.col("o_orderkey").alias("prediction_id"),
                    (F.lit(10) + (F.col("o_orderkey") * 7919 % 9000) / F.lit(100.0)).alias("predicted_impact"))


def _outcomes(spark, sf):
    li = read_table(spark, sf, "lineitem")
    a = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(10) + (F.col("l_orderkey") * 7919 % 9000) / F.lit(100.0)
                                         + (F.col("l_discount") - 0.05) * 200))
    return li.select(F.col("l_orderkey").alias("prediction_id"), F.col("l_linenumber").alias("line"),
                     F.col("l_shipdate").alias("reported_at"), a.alias("actual_impact"))


@query("outcome_join", f"""
WITH {OUTCOME_SQL}
SELECT pr.prediction_id, pr.predicted_impact, fo.actual_impact, fo.reported_at FROM pr LEFT JOIN fo USING (prediction_id)""")
def q_outcome_join(spark, sf):
    """Logged predictions (orders not pending) ⟕ first outcome report (line items, earliest first)."""
    fo = FB.first_outcome(_outcomes(spark, sf), "prediction_id", ["reported_at", "line"])
    return _predictions(spark, sf).join(fo.select("prediction_id", "actual_impact", "reported_at"), "prediction_id", "left")


@query("log_outcome_update", f"""
WITH {OUTCOME_SQL}
SELECT pr.prediction_id, pr.predicted_impact, fo.actual_impact, fo.reported_at FROM pr LEFT JOIN fo USING (prediction_id)""")
def q_log_outcome_update(spark, sf):
    """Predictions stored as a bucketed log, outcomes merged into it in two parts and one of them replayed, then
    compacted; the stored log."""
    from ..session import shared_path
    path = shared_path(spark, "log")
    empty = {"actual_impact": F.lit(None).cast("double"), "reported_at": F.lit(None).cast("date")}
    FB.write_log(_predictions(spark, sf).withColumns(empty), path)
    out = _outcomes(spark, sf).withColumn("reported_at", F.col("reported_at").cast("date"))
    early = out.groupBy("prediction_id").agg(F.min("reported_at").alias("d")).select("prediction_id", F.col("d").alias("reported_at"))
    first = out.join(early, ["prediction_id", "reported_at"], "left_semi")
    for part in (first, out, first):
        FB.update_log(spark, path, part, ["reported_at", "line"])
    FB.compact_log(spark, path)
    return spark.read.parquet(path).drop("bucket")


@query("outcome_not_found", f"""
WITH {OUTCOME_SQL}
SELECT prediction_id, line FROM oc WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.prediction_id = oc.prediction_id)""")
def q_outcome_not_found(spark, sf):
    """Outcome reports whose prediction id is not in the log (anti join) → 'not found'."""
    return _outcomes(spark, sf).join(_predictions(spark, sf), "prediction_id", "left_anti").select("prediction_id", "line")


@query("model_drift", f"""
WITH {LOG_SQL},
r AS (SELECT * FROM lg WHERE ts > TIMESTAMP '{DRIFT_NOW}' - INTERVAL 30 DAY AND actual_impact IS NOT NULL),
a AS (SELECT count(*) AS n, avg(error_abs) AS mae, avg(error_pct) AS mape, avg(CAST(class_correct AS DOUBLE)) * 100 AS acc FROM r)
SELECT CASE WHEN n < 10 THEN 'insufficient_data' WHEN mae > 5.0 OR acc < 70.0 THEN 'drift_detected' ELSE 'model_healthy' END AS status,
  30 AS window_days, n AS predictions_analyzed, CASE WHEN n >= 10 THEN mae END AS mae, CASE WHEN n >= 10 THEN mape END AS mape,
  CASE WHEN n >= 10 THEN acc END AS class_accuracy_pct, CASE WHEN n >= 10 THEN (mae > 5.0 OR acc < 70.0) END AS drift_detected,
  CASE WHEN n >= 10 THEN CASE WHEN mae > 5.0 OR acc < 70.0 THEN 'Consider model retraining' ELSE 'Model performing well' END END AS recommendation
FROM a""")
def q_model_drift(spark, sf):
    """M24."""
    return FB.drift(_log(spark, sf), DRIFT_NOW, 30)


@query("feedback_overall", f"""
WITH {LOG_SQL}
SELECT count(*) AS total_predictions, count(actual_impact) AS predictions_with_outcomes,
  avg(CASE WHEN actual_impact IS NOT NULL THEN error_abs END) AS mean_absolute_error,
  avg(CASE WHEN actual_impact IS NOT NULL THEN error_pct END) AS mean_percentage_error,
  avg(CASE WHEN actual_impact IS NOT NULL THEN CAST(class_correct AS DOUBLE) END) * 100 AS overall_class_accuracy_pct,
  count(actual_impact) * 100.0 / count(*) AS outcome_reporting_rate FROM lg""")
def q_feedback_overall(spark, sf):
    """M25 overall block."""
    return FB.overall(_log(spark, sf))


@query("feedback_by_class", f"""
WITH {LOG_SQL}
SELECT predicted_class, sum(CASE WHEN class_correct THEN 1 ELSE 0 END) * 100.0 / count(*) AS accuracy_pct
FROM lg WHERE actual_impact IS NOT NULL GROUP BY predicted_class""")
def q_feedback_by_class(spark, sf):
    """M25 accuracy by predicted class."""
    return FB.accuracy_by_class(_log(spark, sf))


@query("feedback_by_hour", f"""
WITH {LOG_SQL} SELECT hour, avg(error_abs) AS mae FROM lg WHERE actual_impact IS NOT NULL GROUP BY hour""")
def q_feedback_by_hour(spark, sf):
    """M25 temporal performance."""
    return FB.by_hour(_log(spark, sf))


@query("feedback_best_corridors", f"""
WITH {LOG_SQL}
SELECT corridor, avg(error_abs) AS mae FROM lg WHERE actual_impact IS NOT NULL AND corridor <> 'Non-corridor'
GROUP BY corridor ORDER BY mae ASC NULLS LAST, corridor LIMIT 5""")
def q_feedback_best_corridors(spark, sf):
    """M25 / O04."""
    return FB.best_corridors(_log(spark, sf))


@query("feedback_weak_spots", f"""
WITH {LOG_SQL},
w AS (SELECT * FROM lg WHERE actual_impact IS NOT NULL),
c AS (SELECT cause, avg(error_abs) AS m, count(error_abs) AS n FROM w GROUP BY cause HAVING count(error_abs) >= 3),
wc AS (SELECT * FROM c ORDER BY m DESC, cause LIMIT 1),
cl AS (SELECT avg(error_abs) AS m FROM w WHERE closure = 1),
nd AS (SELECT count(*) FILTER (WHERE hour IN (22, 23, 0, 1, 2, 3, 4, 5)) AS nn,
         avg(error_abs) FILTER (WHERE hour IN (22, 23, 0, 1, 2, 3, 4, 5)) AS ne,
         avg(error_abs) FILTER (WHERE hour NOT IN (22, 23, 0, 1, 2, 3, 4, 5)) AS de FROM w)
SELECT 'cause' AS category, cause AS value, m AS avg_error, CAST(n AS BIGINT) AS count FROM wc WHERE m > 7.0
UNION ALL SELECT 'closure_events', 'Road closure cases', m, NULL FROM cl WHERE m > 8.0
UNION ALL SELECT 'temporal', 'Night hours (22:00-6:00)', ne, NULL FROM nd WHERE nn >= 5 AND ne > de * 1.5""")
def q_feedback_weak_spots(spark, sf):
    """M26."""
    return FB.weak_spots(_log(spark, sf))


@query("regression_metrics", """
WITH d AS (SELECT predicted_impact AS p, actual_impact AS a FROM plog WHERE actual_impact IS NOT NULL AND predicted_impact IS NOT NULL)
SELECT count(*) AS n, avg(abs(a - p)) AS mae, sqrt(avg(pow(a - p, 2))) AS rmse,
  1 - sum(pow(a - p, 2)) / (var_pop(a) * count(*)) AS r2 FROM d""")
def q_regression_metrics(spark, sf):
    """R², MAE, RMSE of the logged predictions."""
    return FB.regression_metrics(X.plog(spark, sf), "actual_impact", "predicted_impact")


@query("confusion_matrix", f"""
WITH {LOG_SQL} SELECT actual_class, predicted_class, count(*) AS n FROM lg WHERE actual_class IS NOT NULL
GROUP BY actual_class, predicted_class""")
def q_confusion_matrix(spark, sf):
    """L04."""
    return FB.confusion(_log(spark, sf))


@query("per_class_accuracy", f"""
WITH {LOG_SQL} SELECT actual_class, count(*) AS n, avg(CASE WHEN actual_class = predicted_class THEN 1.0 ELSE 0.0 END) * 100 AS accuracy_pct
FROM lg WHERE actual_class IS NOT NULL GROUP BY actual_class""")
def q_per_class_accuracy(spark, sf):
    """Per actual class share predicted correctly."""
    d = _log(spark, sf).filter(F.col("actual_class").isNotNull())
    return d.groupBy("actual_class").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.when(F.col("actual_class") == F.col("predicted_class"), 1.0).otherwise(0.0)) * 100).alias("accuracy_pct"))


@query("classification_metrics", f"""
WITH {LOG_SQL}, d AS (SELECT * FROM lg WHERE actual_class IS NOT NULL),
k AS (SELECT c FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) t(c)),
s AS (SELECT c, count(*) FILTER (WHERE actual_class = c AND predicted_class = c) AS tp,
        count(*) FILTER (WHERE actual_class = c) AS ac, count(*) FILTER (WHERE predicted_class = c) AS pc FROM k, d GROUP BY c)
SELECT (SELECT count(*) FILTER (WHERE actual_class = predicted_class) * 100.0 / count(*) FROM d) AS accuracy_pct,
  (SELECT sum(CASE WHEN ac + pc > 0 THEN 2.0 * tp / (ac + pc) ELSE 0 END) / 4 FROM s) AS macro_f1,
  (SELECT CASE WHEN ac > 0 THEN tp * 100.0 / ac END FROM s WHERE c = 'Critical') AS critical_recall_pct""")
def q_classification_metrics(spark, sf):
    """Accuracy, macro F1, Critical recall."""
    return FB.classification_metrics(_log(spark, sf))


@query("residual_stats", """
SELECT count(*) AS n, avg(actual_impact - predicted_impact) AS residual_mean, stddev_samp(actual_impact - predicted_impact) AS residual_std,
  min(actual_impact - predicted_impact) AS residual_min, max(actual_impact - predicted_impact) AS residual_max
FROM plog WHERE actual_impact IS NOT NULL""")
def q_residual_stats(spark, sf):
    """Residual mean / sample std / range."""
    d = X.plog(spark, sf).filter(F.col("actual_impact").isNotNull())
    r = F.col("actual_impact") - F.col("predicted_impact")
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("residual_mean"), F.stddev_samp(r).alias("residual_std"),
                 F.min(r).alias("residual_min"), F.max(r).alias("residual_max"))
