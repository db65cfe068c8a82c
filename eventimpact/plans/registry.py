"""Query registry: ``key -> (spark plan builder, oracle SQL)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .oracle import round_wrap, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Output formatting: doubles rounded to ``digits`` so engines agree beyond summation-order noise."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # nudge 1e-9 away from zero so exact decimal ties (common for means of short decimals) round the
            # same way in every engine whatever the summation order; +0.0 turns -0.0 into 0.0
            x = F.col(f"`{f.name}`").cast("double")
            cols.append((F.round(x + F.lit(1e-9) * F.signum(x), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``sql`` is its DuckDB oracle (None → rows-only)."""

    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            return round_doubles(_fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = round_wrap(with_views(sql), output_schemas().get(name, []))
        return fn

    return deco


_DOUBLES: dict | None = None


def output_schemas() -> dict[str, list[list[str]]]:
    """Spark output schema per key, ``[[name, simpleString type], ...]`` (tools/make_manifest.py)."""
    global _DOUBLES
    if _DOUBLES is None:
        import json
        import os
        p = os.path.join(os.path.dirname(__file__), "output_schemas.json")
        _DOUBLES = json.load(open(p)) if os.path.exists(p) else {}
    return _DOUBLES


def load_all() -> None:
    from . import (q_basic, q_eda, q_profiles, q_windows, q_scoring, q_forecast,  # noqa: F401
                   q_feedback, q_misc, q_streaming, q_ml, q_quality)
