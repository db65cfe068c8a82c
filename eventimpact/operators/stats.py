"""Column-global statistics joined back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, StructField, StructType

from ..session import written


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row as ONE struct-valued scalar subquery (computed once, its value
    inlined into the projection — no join)."""
    cols = scalars.columns
    s = scalars.select(F.struct(*cols).alias("__s")).scalar()
    out = df.withColumn("__s", s)
    return out.select(*df.columns, *[F.col("__s")[c].alias(c) for c in cols])


def exact_quantiles(df: DataFrame, col: str, probs: list[float], groups: list[str] | None = None,
                    names: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (A07–A09), one row per group: ``names`` (default q0, q1, …) and
    ``n``, the count of non-NULL values.

    The values are counted, their running count is taken over ranges of the value order (``running_total``), and
    the values at the two middle ranks are picked by a partial aggregate. No task holds a group's values, as
    ``percentile`` would: its buffer is one value → count map per group. A group without values has no row.
    """
    groups, names = groups or [], names or [f"q{i}" for i in range(len(probs))]
    keys = [F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]
    gs = [f"__g{i}" for i in range(len(groups))]
    vals = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("__x")).agg(
        F.count(F.lit(1)).alias("__c"))
    vals = written(vals, "values")                         # the ranges read the counts several times, ``df`` is evaluated once
    cum = running_total(vals, [*gs, "__x"], "__c", "__end").withColumn("__begin", F.col("__end") - F.col("__c"))
    span = cum.groupBy(*gs).agg(F.min("__begin").alias("__lo"), (F.max("__end") - F.min("__begin")).alias("__n"))
    if gs:
        s = span.select(*[F.col(g).alias(f"s{g}") for g in gs], "__lo", "__n")
        on = [F.col(g).eqNullSafe(F.col(f"s{g}")) for g in gs]
        rows = cum.join(s, on).drop(*[f"s{g}" for g in gs])
    else:
        rows = with_scalars(cum, span)
    picks = []
    for i, p in enumerate(probs):
        at = F.lit(p) * (F.col("__n") - 1)
        for tag, r in (("a", F.floor(at)), ("b", F.ceil(at))):
            hit = (F.col("__begin") - F.col("__lo") <= r) & (r < F.col("__end") - F.col("__lo"))
            picks.append(F.max(F.when(hit, F.col("__x"))).alias(f"__{tag}{i}"))
    got = rows.groupBy(*gs).agg(F.max("__n").alias("n"), *picks)
    if not gs:
        got = got.withColumn("n", F.coalesce("n", F.lit(0)))
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        at = F.lit(p) * (F.col("n") - 1)
        out.append((F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (at - F.floor(at))).alias(name))
    return got.select(*[F.col(g).alias(o) for g, o in zip(gs, groups)], *out, F.col("n").cast("long").alias("n"))


def with_quantiles(agg: DataFrame, quantiles: DataFrame, groups: list[str]) -> DataFrame:
    """``agg`` left join the quantile columns on its group keys (NULL keys are a group of their own)."""
    q = quantiles.drop("n").select(*[F.col(g).alias(f"__q_{g}") for g in groups],
                                   *[c for c in quantiles.columns if c not in [*groups, "n"]])
    on = [F.col(g).eqNullSafe(F.col(f"__q_{g}")) for g in groups]
    return agg.join(q, on, "left").drop(*[f"__q_{g}" for g in groups])


def impute_median(df: DataFrame, col: str, out: str) -> DataFrame:
    """``out = coalesce(col, median(col))`` with the exact median over the whole frame."""
    m = exact_quantiles(df, col, [0.5], names=["__median"]).drop("n")
    return with_scalars(df, m).withColumn(out, F.coalesce(F.col(col), F.col("__median"))).drop("__median")


def standard_scale(df: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """(x − mean) / population std over NULL→0 values; zero std → scale 1."""
    aggs = []
    for c in cols:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs += [F.avg(x).alias(f"__mu_{c}"), F.stddev_pop(x).alias(f"__sd_{c}")]
    out = with_scalars(df, df.agg(*aggs))
    for c in cols:
        sd = F.col(f"__sd_{c}")
        scale = F.when(sd == 0, 1.0).otherwise(sd)
        out = out.withColumn(c + suffix, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"__mu_{c}")) / scale)
    return out.drop(*[f"__mu_{c}" for c in cols], *[f"__sd_{c}" for c in cols])


def minmax_scale(df: DataFrame, cols: list[str], suffix: str = "_mm") -> DataFrame:
    """(x − min) / (max − min); constant column → 0."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}")]
    out = with_scalars(df, df.agg(*aggs))
    for c in cols:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        out = out.withColumn(c + suffix, F.when(hi == lo, 0.0).otherwise((F.col(c) - lo) / (hi - lo)))
    return out.drop(*[f"__lo_{c}" for c in cols], *[f"__hi_{c}" for c in cols])


def equal_width_bin(df: DataFrame, col: str, out: str, bins: int = 10) -> DataFrame:
    """``pd.cut(bins=n, labels=False)`` — right-closed equal-width bins over [min, max], the first
    bin includes min, NULL → 0, a constant column → bin (n-1)//2 (pandas widens the range symmetrically)."""
    m = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    x, lo, hi = F.col(col), F.col("__lo"), F.col("__hi")
    b = F.greatest(F.ceil((x - lo) / (hi - lo) * bins) - 1, F.lit(0))
    expr = (F.when(x.isNull(), 0).when(hi == lo, (bins - 1) // 2)
            .otherwise(F.least(b, F.lit(bins - 1)))).cast("int")
    return with_scalars(df, m).withColumn(out, expr).drop("__lo", "__hi")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """A10: equal-width histogram, left-closed bins with the last bin closed (numpy rule).

    Partial aggregation per bin: the shuffle carries at most ``bins`` rows per task.
    """
    m = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    x, lo, hi = F.col(col), F.col("__lo"), F.col("__hi")
    w = (hi - lo) / bins
    b = F.when(hi == lo, 0).otherwise(F.least(F.floor((x - lo) / w), F.lit(bins - 1))).cast("int")
    binned = with_scalars(df.filter(x.isNotNull()), m).withColumn("bin", b)
    return (binned.groupBy("bin", "__lo", "__hi").agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / bins).alias("bin_lo"),
                    (F.col("__lo") + (F.col("bin") + 1) * (F.col("__hi") - F.col("__lo")) / bins).alias("bin_hi"),
                    "n"))


def split_points(df: DataFrame, cols: list[str], parts: int, per_part: int = 32) -> list:
    """At most ``parts - 1`` rows that cut the order of ``cols`` into ranges of about equal size.

    The sample is the distinct keys whose hash lies below a threshold that lets about ``parts * per_part`` rows pass:
    bounded, the same on every run, and chosen before anything is shuffled."""
    share = int(min(1.0, parts * per_part / max(df.count(), 1)) * (1 << 30))
    some = df.select(*cols).filter(F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) < share)
    rows = some.distinct().orderBy(*cols).collect()
    return [rows[i * len(rows) // parts] for i in range(1, parts) if len(rows) >= parts]


def with_range(df: DataFrame, cols: list[str], points: list, out: str) -> DataFrame:
    """``df`` with the number of the range that a row's key falls in, the count of points below it: a pure function of
    the key. The points are one sorted array, read as a scalar; a row finds its place by binary search, so neither the
    plan nor the work of planning grows with the ranges."""
    if not points:
        return df.withColumn(out, F.lit(0))
    kind = StructType([StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(cols)])
    table = df.sparkSession.createDataFrame([([tuple(p) for p in points],)], StructType([StructField("p", ArrayType(kind))]))
    key = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    steps = len(points).bit_length()
    jumps = F.array(*[F.lit(1 << (steps - 1 - i)) for i in range(steps)])

    def step(at, jump):
        to = at + jump
        below = (to <= len(points)) & (F.element_at("__range_points", F.least(to, F.lit(len(points)))) < F.col("__range_key"))
        return F.when(below, to).otherwise(at)

    found = df.withColumn("__range_points", table.select("p").scalar()).withColumn("__range_key", key)
    return found.withColumn(out, F.aggregate(jumps, F.lit(0), step)).drop("__range_points", "__range_key")


def running_total(vals: DataFrame, cols: str | list[str], weight: str, out: str, partitions: int | None = None) -> DataFrame:
    """Running total of ``weight`` in the order of ``cols``, over a table of distinct keys — distributed.

    The key order is cut at split points of a sample, so a row's range is a pure function of its key and the two
    branches below agree whether or not Spark reuses an exchange. Each range gets a local running sum and the
    total of all lower ranges (one row per range). No task sees more than one range.
    """
    cols = [cols] if isinstance(cols, str) else cols
    n = partitions or int(vals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = with_range(vals, cols, split_points(vals, cols, n), "__rp")
    local = Window.partitionBy("__rp").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    offs = v.groupBy("__rp").agg(F.sum(weight).alias("__pt"))
    offs = offs.withColumn("__off", F.coalesce(
        F.sum("__pt").over(Window.orderBy("__rp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    v = v.withColumn("__local", F.sum(weight).over(local))
    return (v.join(F.broadcast(offs.select("__rp", "__off")), "__rp")      # one row per range
            .withColumn(out, F.col("__local") + F.col("__off")).drop("__rp", "__local", "__off"))


def percentile_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Pandas ``rank(pct=True)`` — average rank of ties divided by the count of non-NULL values.

    Scale plan: aggregate to (value, count) first, take the distributed running total over the distinct values
    (``running_total``), attach the grand total as a scalar, and join the rank back by value.
    """
    vals = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_total(vals, col, "__n", "__cum")
    ranked = with_scalars(ranked, vals.agg(F.sum("__n").alias("__tot")))
    ranked = ranked.select(col, ((F.col("__cum") - (F.col("__n") - 1) / 2.0) / F.col("__tot")).alias(out))
    return df.join(ranked, on=col, how="left")


def impute_end(df: DataFrame, start: str, end: str, resolved: str | None, out: str = "duration_minutes") -> DataFrame:
    """P17 + F14: missing end → resolved time when present, then the global median duration fills the rest."""
    from ..functions.temporal import duration_minutes
    e = F.coalesce(F.col(end), F.col(resolved)) if resolved else F.col(end)
    d = df.withColumn("__dur", duration_minutes(F.col(start), e))
    return impute_median(d, "__dur", out).drop("__dur")


def fallback_to_centroid(df: DataFrame, centroids: DataFrame, lat: str = "latitude", lon: str = "longitude",
                         key: str = "corridor", drop_invalid: bool = False) -> DataFrame:
    """A (0, 0) or NULL coordinate is invalid → dropped, or replaced by the corridor centroid
    (``centroids``: key, center_lat, center_lon)."""
    bad = F.col(lat).isNull() | F.col(lon).isNull() | ((F.col(lat) == 0) & (F.col(lon) == 0))
    if drop_invalid:
        return df.filter(~bad)
    j = df.join(centroids, key, "left").withColumn("__bad", bad)
    return (j.withColumn(lat, F.when(F.col("__bad"), F.col("center_lat")).otherwise(F.col(lat)))
             .withColumn(lon, F.when(F.col("__bad"), F.col("center_lon")).otherwise(F.col(lon)))
             .drop("center_lat", "center_lon", "__bad"))


def with_holidays(df: DataFrame, holidays: DataFrame, ts: str = "start_datetime", out: str = "is_holiday") -> DataFrame:
    """Holiday flag from a calendar dimension (one row per date; a left join on the date, whose side AQE measures)."""
    h = holidays.select(F.col("date").cast("date").alias("__hd")).distinct().withColumn(out, F.lit(1))
    j = df.join(h, F.to_date(F.col(ts)) == F.col("__hd"), "left")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(0))).drop("__hd")


def drop_if_present(df: DataFrame, *cols: str) -> DataFrame:
    """Drop temporary columns, ignoring names that are absent (``DataFrame.drop`` already does)."""
    return df.drop(*cols)
