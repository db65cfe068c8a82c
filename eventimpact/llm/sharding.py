"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import running_total
from .common import written

ROUNDS = 6


def domain(n: int) -> tuple[int, int]:
    """Sides (a, b) of the permuted rectangle: a * b >= n with fewer than a cells over."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _round(x: Column, k: int, seed: int, m: int) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(seed * 1000 + k)), F.lit(m))


def permute(x: Column, n: int, seed: int = 0, inverse: bool = False) -> Column:
    """The permutation of 0 .. n-1 (or its inverse) as a column expression.

    One pass is ``ROUNDS`` Feistel rounds over the a x b rectangle, each adding a hash of one half to the other.
    A result of n or more walks on along its cycle. At most a - 1 cells lie outside, so a walk is at most that
    long; ``steps`` covers every walk where a is small, and elsewhere the chance of a longer one is below
    (1 / a) ** 24, in which case the query stops with an error rather than lose a row.
    """
    a, b = domain(n)

    def once(y: Column) -> Column:
        left, right = F.floor(y / b) if a * b < 2**52 else None, y % b
        if left is None:
            left = (y - right).cast("decimal(38,0)") / F.lit(b).cast("decimal(38,0)")
        left, right = left.cast("long"), right.cast("long")
        for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            sign = -1 if inverse else 1
            if k % 2 == 0:
                left = F.pmod(left + F.lit(sign) * _round(right, k, seed, a), F.lit(a))
            else:
                right = F.pmod(right + F.lit(sign) * _round(left, k, seed, b), F.lit(b))
        return left * b + right

    x = x.cast("long")
    over = a * b - n
    if not over:
        return once(x)
    steps = min(over, 24)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once(x),
                         lambda y, _: F.when(y >= n, once(y)).otherwise(y))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def place(row: Column, n: int, shards: int, seed: int = 0) -> tuple[Column, Column]:
    """(shard, slot) of a global row number: computable for any row without the table."""
    at = permute(row, n, seed)
    return (at % shards).cast("int"), F.floor((at - at % shards) / shards).cast("long")


def shard_rows(df: DataFrame, columns: list[str], shards: int = 24, seed: int = 0) -> DataFrame:
    """The ``columns`` of every row with ``row_number`` (its place in the order of the columns, from 0), ``shard``
    and ``slot``. Counts of shards differ by at most one; slots are gapless from 0 in each shard.

    Equal rows are counted before they are shuffled and get a run of numbers, which is dealt out again after the
    numbering, so neither a hot id nor a row repeated for a third of the table meets in one task. Nulls come
    first in the order. A column of the input with a clashing name is replaced; others are not returned. An
    empty table gives an empty result.
    """
    taken = {"row_number", "shard", "slot"}
    columns = [c for c in columns if c.lower() not in taken]
    rows = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("__n"))
    rows = written(rows, "counted")
    n = rows.agg(F.sum("__n")).first()[0] or 0
    numbered = running_total(rows, columns, "__n", "__end")
    run = 1 << 16
    parts = numbered.withColumn("__lo", F.explode(F.sequence(F.col("__end") - F.col("__n"), F.col("__end") - 1, F.lit(run))))
    long_runs = parts.filter(F.col("__n") > run).repartition("__lo")
    each = parts.filter(F.col("__n") <= run).unionAll(long_runs).withColumn(
        "row_number", F.explode(F.sequence("__lo", F.least(F.col("__end"), F.col("__lo") + run) - 1)))
    shard, slot = place(F.col("row_number"), max(n, 1), shards, seed)
    return each.select(*[F.col(f"`{c}`") for c in columns], F.col("row_number"), shard.alias("shard"), slot.alias("slot"))
