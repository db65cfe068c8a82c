"""Column-global encodings (E01–E03) built from distinct values, joined back by value.

The dictionary of all encoded columns is one table of distinct (column, value) pairs: one aggregate and one
distributed running count (``operators.stats.running_total``), whatever the number of columns. The joins back are
plain equi-joins: AQE broadcasts a dictionary that it has measured small and keeps a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def label_encode(df: DataFrame, codes: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Alphabetical 0-based codes (``LabelEncoder`` order = code-point order = Spark binary order).

    ``codes`` maps an output column to (column, fill of its NULLs or None). A value's code is the number of smaller
    distinct values of its column, NULL first.
    """
    from ..operators.stats import running_total
    src = {out: F.coalesce(F.col(c).cast("string"), F.lit(fill)) if fill is not None else F.col(c).cast("string")
           for out, (c, fill) in codes.items()}
    pairs = F.array(*[F.struct(F.lit(i).alias("k"), s.alias("v")) for i, s in enumerate(src.values())])
    words = df.select(F.explode(pairs).alias("p")).select("p.*").distinct().withColumn("one", F.lit(1))
    words = running_total(words, ["k", "v"], "one", "c")
    start = words.groupBy("k").agg(F.min("c").alias("first"))                    # one row per encoded column
    words = written(words.join(F.broadcast(start), "k").select("k", "v", (F.col("c") - F.col("first")).cast("int").alias("code")), "codes")
    out = df
    for i, (name, s) in enumerate(src.items()):
        d = words.filter(F.col("k") == i).select(F.col("v").alias("__v"), F.col("code").alias(name))
        out = out.withColumn("__s", s)
        out = out.join(d, F.col("__s").eqNullSafe(F.col("__v")), "left").drop("__s", "__v")
    return out


def appearance_encode(df: DataFrame, col: str, out: str, order_cols: list[str]) -> DataFrame:
    """0-based code in order of first appearance (first = smallest ``order_cols`` tuple)."""
    from ..operators.stats import running_total
    first = df.groupBy(col).agg(F.min(F.struct(*order_cols)).alias("__first")).withColumn("__one", F.lit(1))
    first = running_total(first, "__first", "__one", "__c").select(col, (F.col("__c") - 1).cast("int").alias(out))
    return df.join(first, col, "left")
