"""Window features without look-ahead.

Scale rule: a window partitioned only by a category key puts a hot key (one corridor may hold a third of all
rows) into one task. The rows are therefore cut into ranges of (key, time, id) order at split points of about
equal size (``stats.split_points``), so a hot key, or a hot day of it, spans many ranges. A window runs inside one
(key, range), and what lies before it in the key comes from a pre-aggregate with one row per (key, range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .stats import split_points, with_range

DAY_US = 86400 * 1000000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``__rp``, the range of the row's key: a pure function of ``cols``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_range(df, cols, split_points(df, cols, n), "__rp")


def _earlier(key: str) -> Window:
    return Window.partitionBy(key).orderBy("__rp").rowsBetween(Window.unboundedPreceding, -1)


def prior_count(df: DataFrame, key: str, out: str, ts: str = "start_datetime", order_id: str = "id") -> DataFrame:
    """Number of earlier rows with the same key in (ts, id) order (pandas ``cumcount``); NULL key → NULL."""
    d = _ranges(df, [key, ts, order_id])
    parts = d.filter(F.col(key).isNotNull()).groupBy(key, "__rp").agg(F.count(F.lit(1)).alias("__n"))
    parts = parts.select(key, "__rp", F.coalesce(F.sum("__n").over(_earlier(key)), F.lit(0)).alias("__before"))
    wi = Window.partitionBy(key, "__rp").orderBy(F.col(ts), F.col(order_id))
    d = d.withColumn("__in", F.row_number().over(wi) - 1).join(parts, [key, "__rp"], "left")
    return d.withColumn(out, F.when(F.col(key).isNotNull(), F.col("__before") + F.col("__in")).cast("long")).drop(
        "__rp", "__before", "__in")


def expanding_rate(df: DataFrame, key: str, flag: str, incl: str | None, prior: str | None = None,
                   ts: str = "start_datetime", order_id: str = "id") -> DataFrame:
    """Running mean of ``flag`` per key in (ts, id) order, both forms from one window. ``incl`` names the
    reference's form (the row's own flag leaks in), ``prior`` the leak-free one (0 for the first row)."""
    d = _ranges(df, [key, ts, order_id])
    parts = d.groupBy(key, "__rp").agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum(flag), F.lit(0)).alias("__s"))
    w = _earlier(key)
    parts = parts.select(F.col(key).alias("__k"), F.col("__rp").alias("__r"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__bn"),
                         F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__bs"))
    wi = Window.partitionBy(key, "__rp").orderBy(F.col(ts), F.col(order_id)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__in", F.count(F.lit(1)).over(wi)).withColumn("__is", F.coalesce(F.sum(flag).over(wi), F.lit(0)))
    d = d.join(parts, (F.col("__rp") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__k")), "left")
    n, s, own = F.col("__bn") + F.col("__in"), F.col("__bs") + F.col("__is"), F.coalesce(F.col(flag), F.lit(0))
    if incl:
        d = d.withColumn(incl, s / n)
    if prior:
        d = d.withColumn(prior, F.when(n > 1, (s - own) / (n - 1)).otherwise(F.lit(0.0)))
    return d.drop("__rp", "__in", "__is", "__k", "__r", "__bn", "__bs")


def trailing_count(df: DataFrame, key: str, out: str, id_col: str = "id", days: int = 7,
                   ts: str = "start_datetime", valid: Column | None = None) -> DataFrame:
    """Rows with the same key and time in [t − days, t) (strict), for rows where ``valid`` holds;
    other rows (and rows without key or time) get 0. No self join and no window over a whole key.

    Each valid row sends one probe to t − days. A row's count of strictly earlier rows of its key, less its probe's,
    is the answer; both come from one running count over the rows and probes of a (key, range of times), plus the
    rows of the key in earlier ranges.
    """
    valid = valid if valid is not None else F.lit(True)
    src = (df.select(F.col(id_col).alias("__id"), F.col(key).alias("__key"), _micros(ts).alias("__us"), valid.alias("__v"))
           .filter(F.col("__key").isNotNull() & F.col("__us").isNotNull()))
    real = src.select("__id", "__key", "__us", F.lit(1).alias("__real"), "__v")
    probe = src.filter("__v").select("__id", "__key", (F.col("__us") - days * DAY_US).alias("__us"), F.lit(0).alias("__real"), "__v")
    d = _ranges(real.unionByName(probe), ["__key", "__us"])
    parts = d.groupBy("__key", "__rp").agg(F.sum("__real").alias("__n"))
    parts = parts.select("__key", "__rp", F.coalesce(F.sum("__n").over(_earlier("__key")), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__key", "__rp").orderBy("__us").rangeBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__in", F.coalesce(F.sum("__real").over(w), F.lit(0))).join(parts, ["__key", "__rp"])
    less = F.col("__before") + F.col("__in")
    cnt = d.filter("__v").groupBy("__id").agg(F.sum(F.when(F.col("__real") == 1, less).otherwise(-less)).alias("__cnt"))
    return (df.join(cnt, F.col(id_col) == F.col("__id"), "left")
            .withColumn(out, F.coalesce(F.col("__cnt"), F.lit(0)).cast("long")).drop("__cnt", "__id"))


def days_since_last(df: DataFrame, key: str, out: str, ts: str = "start_datetime", order_id: str = "id") -> DataFrame:
    """W09 (grain ours): days between a row and the previous row of the same key (NULL for the first).

    ``lag`` needs the previous row: inside a (key, range) it is the row before, and the first row of a range takes the
    last time of the key's previous range from the pre-aggregate.
    """
    d = _ranges(df, [key, ts, order_id])
    parts = d.filter(F.col(key).isNotNull()).groupBy(key, "__rp").agg(F.max(F.col(ts)).alias("__last"))
    parts = parts.select(key, "__rp", F.lag("__last").over(Window.partitionBy(key).orderBy("__rp")).alias("__prev_part"))
    wi = Window.partitionBy(key, "__rp").orderBy(F.col(ts), F.col(order_id))
    d = d.withColumn("__prev_in", F.lag(F.col(ts)).over(wi)).join(parts, [key, "__rp"], "left")
    prev = F.coalesce(F.col("__prev_in"), F.col("__prev_part"))
    secs = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
    return d.withColumn(out, F.when(F.col(key).isNotNull(), secs / F.lit(float(DAY_US)))).drop("__rp", "__prev_in", "__prev_part")


def hash_split(key: Column, test_pct: int = 20, salt: str = "42") -> Column:
    """Deterministic 80/20 split by md5 bucket (stable under repartitioning, unlike ``randomSplit``)."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10)
                    .cast("long"), F.lit(100))
    return F.when(bucket < test_pct, "test").otherwise("train")
