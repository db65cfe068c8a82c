"""File sources and sinks (S01, S03–S08, S12) with explicit schemas — no inference on the hot path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

RAW_INCIDENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("event_cause", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("start_datetime", T.StringType()),
    T.StructField("end_datetime", T.StringType()), T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()), T.StructField("endlatitude", T.DoubleType()),
    T.StructField("endlongitude", T.DoubleType()), T.StructField("corridor", T.StringType()),
    T.StructField("police_station", T.StringType()), T.StructField("junction", T.StringType()),
    T.StructField("veh_type", T.StringType()), T.StructField("requires_road_closure", T.BooleanType()),
    T.StructField("authenticated", T.StringType()), T.StructField("description", T.StringType()),
])

PLANNED_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.IntegerType()), T.StructField("event_name", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("start_time", T.StringType()), T.StructField("end_time", T.StringType()),
    T.StructField("corridor", T.StringType()), T.StructField("location", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("expected_crowd", T.IntegerType()), T.StructField("closure_required", T.BooleanType()),
    T.StructField("tier_affected", T.IntegerType()),
])

RESOURCE_TEMPLATE_TYPE = T.MapType(T.StringType(), T.StructType([
    T.StructField("timeline", T.ArrayType(T.StructType([T.StructField("phase", T.StringType()),
                                                        T.StructField("actions", T.ArrayType(T.StringType()))]))),
    T.StructField("resolution", T.StructType([T.StructField("median", T.StringType()),
                                              T.StructField("range", T.StringType())])),
    T.StructField("resources", T.StructType([T.StructField("police", T.IntegerType()),
                                             T.StructField("barricades", T.IntegerType()),
                                             T.StructField("crew", T.StringType()),
                                             T.StructField("tow", T.IntegerType()),
                                             T.StructField("diversion", T.BooleanType())])),
]))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in the file system that its own URI names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_raw_incidents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV, fixed schema, PERMISSIVE (malformed fields → NULL). ``multi_line`` allows line breaks inside
    quoted fields, at the price of one task per file."""
    return (spark.read.schema(RAW_INCIDENT_SCHEMA).option("header", True).option("mode", "PERMISSIVE")
            .option("multiLine", multi_line).option("escape", '"').csv(path))


def read_with_quarantine(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows) of raw incident CSV files; together they are all lines.

    A bad row keeps its raw ``line`` and the ``reason``: ``short line`` or ``long line`` (number of fields), ``wrong type``
    (a field that does not read as its column's type), ``no time`` or ``unparsable time`` (start of the incident). The
    reader fills the corrupt-record column where a line does not fit the schema; the fields of such a line are counted to
    tell why."""
    names = RAW_INCIDENT_SCHEMA.names
    schema = T.StructType([*RAW_INCIDENT_SCHEMA.fields, T.StructField("__line", T.StringType())])
    raw = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
           .option("columnNameOfCorruptRecord", "__line").option("columnPruning", False).csv(path))   # all fields are read, whatever is asked
    bare = F.regexp_replace("__line", '"([^"]|"")*"', "")                    # quoted fields hold no separators
    held = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    start = F.trim(F.coalesce("start_datetime", F.lit("")))
    reason = (F.when(F.col("__line").isNotNull(), F.when(F.col("__n") < len(names), "short line").when(F.col("__n") > len(names), "long line")
                     .otherwise("wrong type"))
              .when(start == "", "no time").when(F.try_to_timestamp("start_datetime").isNull(), "unparsable time"))
    told = raw.withColumn("__n", F.when(F.col("__line").isNotNull(), held)).withColumn("reason", reason)
    line = F.coalesce("__line", F.to_csv(F.struct(*names)))
    # written once: a reader that is asked for some fields only does not try to convert the others
    told = written(told.select(*names, "reason", F.when(F.col("reason").isNotNull(), line).alias("line")), "raw")
    return told.filter("reason is null").select(*names), told.filter("reason is not null").select("reason", "line")


def clean_incidents(raw: DataFrame) -> DataFrame:
    """Parse times permissively, NULL defaults, flags, time parts, duration minutes."""
    st = F.try_to_timestamp(F.col("start_datetime"))
    en = F.try_to_timestamp(F.col("end_datetime"))
    d = raw.withColumn("start_datetime", st).withColumn("end_datetime", en)
    d = d.fillna({"corridor": "Non-corridor", "event_cause": "others", "veh_type": "unknown", "description": ""})
    from ..functions.temporal import duration_minutes, temporal_parts
    parts = temporal_parts(F.col("start_datetime"))
    return d.select("*", *[c.alias(n) for n, c in parts.items()],
                    (F.col("authenticated") == "yes").cast("int").alias("authenticated_flag"),
                    F.col("requires_road_closure").cast("int").alias("closure"),
                    duration_minutes(F.col("start_datetime"), F.col("end_datetime")).alias("duration_minutes"))


def read_planned_events(spark: SparkSession, path: str) -> DataFrame:
    """Calendar CSV → datetime from date and start-time text, plus hour / weekday / month."""
    d = spark.read.schema(PLANNED_EVENT_SCHEMA).option("header", True).csv(path)
    dt = F.try_to_timestamp(F.concat_ws(" ", F.col("date"), F.col("start_time")))
    return d.withColumn("datetime", dt).select("*", F.hour("datetime").alias("hour"),
                                               F.weekday("datetime").alias("weekday"), F.month("datetime").alias("month"))


def read_resource_templates(spark: SparkSession, path: str) -> DataFrame:
    """The nested JSON lookup ``{cause: {timeline, resolution, resources}}`` → one row per cause."""
    txt = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), RESOURCE_TEMPLATE_TYPE)
    return txt.select(F.explode(m).alias("cause", "t")).select("cause", "t.timeline", "t.resolution", "t.resources")


def write_feature_table(df: DataFrame, path: str, partition_col: str = "month") -> None:
    """Full overwrite, partitioned (month → partition pruning for time-bounded jobs)."""
    df.write.mode("overwrite").partitionBy(partition_col).parquet(path)


def write_profile(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Profile tables (nested arrays kept) as JSON lines or parquet."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_log_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """The prediction log, or an empty typed log when the folder does not exist yet."""
    from ..operators.feedback import PREDICTION_LOG_SCHEMA, empty_log
    if path_exists(spark, path):
        return spark.read.schema(PREDICTION_LOG_SCHEMA).parquet(path)
    return empty_log(spark)


def append_log(df: DataFrame, path: str) -> None:
    """Append records by name (absent columns NULL); no rewrite of earlier files."""
    from ..operators.feedback import PREDICTION_LOG_SCHEMA
    spark = df.sparkSession
    target = spark.createDataFrame([], PREDICTION_LOG_SCHEMA)
    out = target.unionByName(df, allowMissingColumns=True)
    out.select(*target.columns).write.mode("append").parquet(path)


def read_incident_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """The live incident feed as a stream over landed files (Kafka is a drop-in format)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)
