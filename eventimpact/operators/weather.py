"""Weather inputs and water-logging risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.rules import rain_risk, round_half

OBSERVATION_SCHEMA = T.StructType([
    T.StructField("weather", T.ArrayType(T.StructType([T.StructField("main", T.StringType()),
                                                       T.StructField("description", T.StringType())]))),
    T.StructField("main", T.StructType([T.StructField("temp", T.DoubleType()), T.StructField("humidity", T.DoubleType())])),
    T.StructField("rain", T.StructType([T.StructField("1h", T.DoubleType())])),
    T.StructField("visibility", T.LongType()),
    T.StructField("dt", T.LongType()),
])

FORECAST_SCHEMA = T.StructType([T.StructField("list", T.ArrayType(T.StructType([
    T.StructField("dt_txt", T.StringType()),
    T.StructField("weather", T.ArrayType(T.StructType([T.StructField("main", T.StringType())]))),
    T.StructField("main", T.StructType([T.StructField("temp", T.DoubleType())])),
    T.StructField("pop", T.DoubleType()),
    T.StructField("rain", T.StructType([T.StructField("3h", T.DoubleType())])),
])))])


def observations(raw: DataFrame) -> DataFrame:
    """Landed current-weather JSON → one row (rain default 0, visibility default 10 000)."""
    return raw.select(F.col("weather")[0]["main"].alias("condition"), F.col("weather")[0]["description"].alias("description"),
                      F.col("main.temp").alias("temp_celsius"), F.col("main.humidity").alias("humidity"),
                      F.coalesce(F.col("rain.1h"), F.lit(0.0)).alias("rain_1h_mm"),
                      F.coalesce(F.col("visibility"), F.lit(10000)).cast("int").alias("visibility_m"),
                      F.timestamp_seconds("dt").alias("timestamp"))


def forecast_items(raw: DataFrame) -> DataFrame:
    """Forecast JSON list → one row per 3 h item (pop and rain default 0)."""
    it = raw.select(F.explode("list").alias("i"))
    return it.select(F.col("i.dt_txt").alias("datetime"), F.col("i.weather")[0]["main"].alias("condition"),
                     F.col("i.main.temp").alias("temp"), F.coalesce(F.col("i.pop"), F.lit(0.0)).alias("rain_prob"),
                     F.coalesce(F.col("i.rain.3h"), F.lit(0.0)).alias("rain_3h_mm"))


def water_logging_risk(corridors: DataFrame, centroids: DataFrame, items: DataFrame, item_ts: str,
                       now: str, forecast_hours: int = 6) -> DataFrame:
    """Per corridor — the first min(h // 3, n) forecast items at or after ``now``: rain sum → risk tier,
    recommendation, confidence from the mean probability; ``Unknown`` without centroid (J13) or forecast."""
    k = forecast_hours // 3
    f = items.filter(F.col(item_ts) >= F.lit(now).cast("timestamp"))
    w = Window.partitionBy("corridor").orderBy(item_ts)
    f = f.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    agg = f.groupBy("corridor").agg(F.sum("rain_3h_mm").alias("total_rain"), F.avg("rain_prob").alias("avg_prob"),
                                    F.count(F.lit(1)).alias("n_items"))
    c = corridors.join(centroids.select("corridor", F.lit(True).alias("__known")), "corridor", "left").join(
        agg, "corridor", "left")
    known = F.coalesce(F.col("__known"), F.lit(False))
    has = F.col("n_items").isNotNull()
    rain1 = round_half(F.col("total_rain"), 1)
    risk = rain_risk(F.col("total_rain"))
    rec = (F.when(risk == "Critical", F.format_string(
        "URGENT: Deploy water pumps and barricades. Expected %.1fmm rain - severe water logging likely.", rain1))
        .when(risk == "High", F.format_string("Deploy preventive measures. %.1fmm rain forecast - moderate water logging risk.", rain1))
        .when(risk == "Medium", F.format_string("Monitor closely. %.1fmm rain expected - minor pooling possible.", rain1))
        .otherwise(F.lit("Normal operations. Low rain forecast.")))
    conf = F.when(F.col("avg_prob") > 0.7, "High").when(F.col("avg_prob") > 0.4, "Medium").otherwise("Low")
    return c.select(
        "corridor",
        F.when(~known | ~has, F.lit("Unknown")).otherwise(risk).alias("risk_level"),
        F.when(~known, F.lit("Corridor not found")).when(~has, F.lit("Weather data unavailable")).alias("reason"),
        F.when(known & has, rain1).alias("total_rain_mm"),
        F.when(known & has, rec).alias("recommendation"),
        F.when(known & has, conf).alias("confidence"))
