"""Prediction log, outcomes, errors, drift and the feedback report.

The log is an append-only table; outcomes are a second append-only table joined by prediction id (first
outcome per id wins). Every report is one aggregate over the joined log — the same plan serves a batch job
and the ``foreachBatch`` of a stream (R09).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.rules import risk_class
from ..session import written

PREDICTION_LOG_SCHEMA = (
    "timestamp timestamp, prediction_id string, cause string, corridor string, corridor_tier int, closure boolean, "
    "vehicle_type string, hour int, weekday int, predicted_impact double, predicted_class string, "
    "confidence_level string, actual_impact double, actual_class string, actual_resolution_time double, "
    "error_abs double, error_pct double, class_correct boolean")


def empty_log(spark) -> DataFrame:
    """An empty, fully typed prediction log (the reference's empty log is untyped)."""
    return spark.createDataFrame([], PREDICTION_LOG_SCHEMA)


def with_errors(log: DataFrame, pred: str = "predicted_impact", actual: str = "actual_impact") -> DataFrame:
    """Errors only when predicted and actual are both non-zero and non-NULL; pct 0 when actual ≤ 0."""
    p, a = F.col(pred), F.col(actual)
    ok = p.isNotNull() & a.isNotNull() & (p != 0) & (a != 0)
    pc, ac = risk_class(p), risk_class(a)
    return log.select(
        *log.columns,
        pc.alias("predicted_class"), F.when(a.isNotNull(), ac).alias("actual_class"),
        F.when(ok, F.abs(p - a)).alias("error_abs"),
        F.when(ok, F.when(a > 0, F.abs(p - a) / a * 100).otherwise(F.lit(0.0))).alias("error_pct"),
        F.when(ok, pc == ac).alias("class_correct"))


def first_outcome(outcomes: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """The first outcome per prediction id (min of the order tuple, remaining fields break exact ties) —
    an aggregate with partial aggregation, not a window over a possibly hot id."""
    others = [c for c in outcomes.columns if c != key]
    best = F.min(F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in others if c not in order_cols]))
    g = outcomes.groupBy(key).agg(best.alias("__b"))
    return g.select(key, *[F.col("__b")[c].alias(c) for c in others])


def error_sums() -> list:
    """Additive parts of the drift measures, over rows with an outcome."""
    has = F.col("actual_impact").isNotNull()
    out = [F.count(F.when(has, 1)).alias("n")]
    for name, c in (("abs", F.col("error_abs")), ("pct", F.col("error_pct")), ("ok", F.col("class_correct").cast("double"))):
        out += [F.coalesce(F.sum(F.when(has, c)), F.lit(0.0)).alias(f"s_{name}"), F.count(F.when(has, c)).alias(f"n_{name}")]
    return out


def drift_status(sums: DataFrame, window_days: int) -> DataFrame:
    """M24 from summed ``error_sums``: needs ≥ 10 outcomes; MAE, MAPE, class accuracy; drift flag."""
    mean = lambda k: F.when(F.col(f"n_{k}") > 0, F.col(f"s_{k}") / F.col(f"n_{k}"))
    a = sums.select(F.coalesce("n", F.lit(0)).cast("long").alias("predictions_analyzed"), mean("abs").alias("mae"),
                    mean("pct").alias("mape"), (mean("ok") * 100).alias("class_accuracy_pct"))
    enough = F.col("predictions_analyzed") >= 10
    det = (F.col("mae") > 5.0) | (F.col("class_accuracy_pct") < 70.0)
    return a.select(
        F.when(~enough, "insufficient_data").when(det, "drift_detected").otherwise("model_healthy").alias("status"),
        F.lit(window_days).alias("window_days"), "predictions_analyzed",
        F.when(enough, F.col("mae")).alias("mae"), F.when(enough, F.col("mape")).alias("mape"),
        F.when(enough, F.col("class_accuracy_pct")).alias("class_accuracy_pct"),
        F.when(enough, det).alias("drift_detected"),
        F.when(enough, F.when(det, "Consider model retraining").otherwise("Model performing well")).alias("recommendation"))


def drift(log: DataFrame, now: str, window_days: int = 30, ts: str = "ts") -> DataFrame:
    """Strict window ``ts > now − N days``."""
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(window_days))
    return drift_status(log.filter(F.col(ts) > cutoff).agg(*error_sums()), window_days)


def overall(log: DataFrame) -> DataFrame:
    """Overall errors, class accuracy and reporting rate."""
    has = F.col("actual_impact").isNotNull()
    return log.agg(
        F.count(F.lit(1)).alias("total_predictions"), F.count(F.when(has, 1)).alias("predictions_with_outcomes"),
        F.avg(F.when(has, F.col("error_abs"))).alias("mean_absolute_error"),
        F.avg(F.when(has, F.col("error_pct"))).alias("mean_percentage_error"),
        (F.avg(F.when(has, F.col("class_correct").cast("double"))) * 100).alias("overall_class_accuracy_pct"),
        (F.count(F.when(has, 1)) / F.count(F.lit(1)) * 100).alias("outcome_reporting_rate"))


def accuracy_by_class(log: DataFrame) -> DataFrame:
    """Per predicted class — correct / all rows with an outcome (denominator includes NULL correctness)."""
    w = log.filter(F.col("actual_impact").isNotNull())
    return w.groupBy("predicted_class").agg(
        (F.sum(F.when(F.col("class_correct"), 1).otherwise(0)) / F.count(F.lit(1)) * 100).alias("accuracy_pct"))


def by_hour(log: DataFrame) -> DataFrame:
    w = log.filter(F.col("actual_impact").isNotNull())
    return w.groupBy("hour").agg(F.avg("error_abs").alias("mae"))


def best_corridors(log: DataFrame, k: int = 5) -> DataFrame:
    """Lowest-error corridors (Non-corridor excluded), ascending, NULL means last."""
    w = log.filter(F.col("actual_impact").isNotNull() & (F.col("corridor") != "Non-corridor"))
    g = w.groupBy("corridor").agg(F.avg("error_abs").alias("mae"))
    return g.orderBy(F.col("mae").asc_nulls_last(), "corridor").limit(k)


def weak_spots(log: DataFrame) -> DataFrame:
    """Worst cause (≥ 3 errors, MAE > 7); closure MAE > 8; night (≥ 5 rows) MAE > 1.5 × day."""
    w = log.filter(F.col("actual_impact").isNotNull())
    c = w.groupBy("cause").agg(F.avg("error_abs").alias("m"), F.count("error_abs").alias("n")).filter(F.col("n") >= 3)
    # ties on the mean → smallest cause name (pandas idxmax takes the first in sorted index order);
    # the window sees one row per cause
    worst = c.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("m"), "cause"))).filter(F.col("__r") == 1)
    cause = worst.filter(F.col("m") > 7.0).select(
        F.lit("cause").alias("category"), F.col("cause").alias("value"), F.col("m").alias("avg_error"),
        F.col("n").cast("long").alias("count"))
    cl = w.filter(F.col("closure") == 1).agg(F.avg("error_abs").alias("m")).filter(F.col("m") > 8.0).select(
        F.lit("closure_events").alias("category"), F.lit("Road closure cases").alias("value"), F.col("m").alias("avg_error"),
        F.lit(None).cast("long").alias("count"))
    night = F.col("hour").isin(22, 23, 0, 1, 2, 3, 4, 5)
    nd = w.agg(F.count(F.when(night, 1)).alias("nn"), F.avg(F.when(night, F.col("error_abs"))).alias("ne"),
               F.avg(F.when(~night, F.col("error_abs"))).alias("de"))
    nt = nd.filter((F.col("nn") >= 5) & (F.col("ne") > F.col("de") * 1.5)).select(
        F.lit("temporal").alias("category"), F.lit("Night hours (22:00-6:00)").alias("value"),
        F.col("ne").alias("avg_error"), F.lit(None).cast("long").alias("count"))
    return cause.unionByName(cl).unionByName(nt)


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """N, MAE, RMSE and R² (1 − SS_res / SS_tot) in one pass of sums."""
    d = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    a = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(y) - F.col(yhat))).alias("mae"),
              F.sqrt(F.avg(F.pow(F.col(y) - F.col(yhat), 2))).alias("rmse"),
              F.sum(F.pow(F.col(y) - F.col(yhat), 2)).alias("__ssr"), F.var_pop(y).alias("__v"))
    return a.select("n", "mae", "rmse", (1 - F.col("__ssr") / (F.col("__v") * F.col("n"))).alias("r2"))


def confusion(df: DataFrame, actual: str = "actual_class", pred: str = "predicted_class") -> DataFrame:
    """Long-form confusion matrix."""
    return df.filter(F.col(actual).isNotNull()).groupBy(actual, pred).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, actual: str = "actual_class", pred: str = "predicted_class") -> DataFrame:
    """Accuracy, macro F1 over the four classes and Critical recall, from the confusion counts."""
    d = df.filter(F.col(actual).isNotNull())
    classes = ["Low", "Medium", "High", "Critical"]
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(actual) == F.col(pred), 1).otherwise(0)).alias("ok")]
    for c in classes:
        aggs += [F.sum(F.when((F.col(actual) == c) & (F.col(pred) == c), 1).otherwise(0)).alias(f"tp_{c}"),
                 F.sum(F.when(F.col(actual) == c, 1).otherwise(0)).alias(f"a_{c}"),
                 F.sum(F.when(F.col(pred) == c, 1).otherwise(0)).alias(f"p_{c}")]
    a = d.agg(*aggs)

    def f1(c):
        tp, ac, pc = F.col(f"tp_{c}"), F.col(f"a_{c}"), F.col(f"p_{c}")
        return F.when(ac + pc > 0, 2 * tp / (ac + pc)).otherwise(F.lit(0.0))

    macro = sum((f1(c) for c in classes), F.lit(0.0)) / len(classes)
    return a.select((F.col("ok") / F.col("n") * 100).alias("accuracy_pct"), macro.alias("macro_f1"),
                    F.when(F.col("a_Critical") > 0, F.col("tp_Critical") / F.col("a_Critical") * 100).alias("critical_recall_pct"))


def prediction_id(ts, *cols):
    """``PRED_<yyyyMMddHHmmssSSSSSS>_<hash>`` — the reference's timestamp id plus a deterministic hash of the
    record, so two predictions in the same microsecond (any executor) never collide."""
    h = F.lower(F.hex(F.xxhash64(*cols)))
    return F.concat(F.lit("PRED_"), F.date_format(ts, "yyyyMMddHHmmssSSSSSS"), F.lit("_"), h)


def write_log(log: DataFrame, path: str, buckets: int = 64, key: str = "prediction_id") -> None:
    """The prediction log stored in bucket folders by a hash of the prediction id; appends go to the same buckets."""
    b = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int").alias("bucket")
    log.select("*", b).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def update_log(spark, path: str, outcomes: DataFrame, order: list[str], buckets: int = 64, key: str = "prediction_id",
               fields: tuple[str, ...] = ("actual_impact", "reported_at")) -> DataFrame:
    """Merges outcome reports into the stored log and returns the reports whose id the log does not know.

    The first report of an id (by ``order``) counts, and only where the log has no outcome yet, so a replay changes
    nothing. Only buckets that reports touch are read; only buckets in which a row changes are written, by dynamic
    partition overwrite from a staged copy, and all other files stay as they are."""
    first = first_outcome(outcomes, key, order)
    b = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    first = written(first.withColumn("bucket", b), "outcomes")
    log = spark.read.parquet(path)
    touched = [r.bucket for r in first.select("bucket").distinct().collect()]                 # at most ``buckets``
    mine = log.filter(F.col("bucket").isin(touched))
    new = first.select(F.col(key).alias("__key"), F.col("bucket").alias("__bucket"), *[F.col(c).alias(f"__{c}") for c in fields])
    j = mine.join(new, (F.col(key) == F.col("__key")) & (F.col("bucket") == F.col("__bucket")), "left")
    takes = F.col("__key").isNotNull() & F.col(fields[0]).isNull() & F.col(f"__{fields[0]}").isNotNull()
    merged = j.withColumn("__takes", takes)
    merged = merged.select(*[F.when(F.col("__takes"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in log.columns], "__takes")
    staged = written(merged, "merged")
    changed = [r.bucket for r in staged.filter("__takes").select("bucket").distinct().collect()]
    if changed:
        _overwrite(staged.filter(F.col("bucket").isin(changed)).drop("__takes"), path, "bucket")
    known = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).select(key, "bucket")
    return outcomes.withColumn("bucket", b).join(known, [key, "bucket"], "left_anti").drop("bucket")


def compact_log(spark, path: str, most_files: int = 4, part: str = "bucket") -> list:
    """Rewrites the buckets that hold more than ``most_files`` files, as one file each; returns them."""
    log = spark.read.parquet(path)
    files = log.select(part, F.input_file_name().alias("f")).distinct().groupBy(part).count().filter(F.col("count") > most_files)
    full = [r[0] for r in files.collect()]
    if full:
        _overwrite(written(log.filter(F.col(part).isin(full)), "compact"), path, part)
    return sorted(full)


def _overwrite(staged: DataFrame, path: str, part: str) -> None:
    """Replaces the partitions that ``staged`` holds, and no others."""
    staged.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
