"""String functions (G01–G07) as native expressions. Whole texts are scanned; nothing is truncated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Script range used by the reference (Kannada block); the range is a parameter.
KANNADA_RANGE = ("0C80", "0CFF")
WHITESPACE_RUN = r"[^ \t\n\r\f\x0B]+"


def has_script(text: Column, lo: str = KANNADA_RANGE[0], hi: str = KANNADA_RANGE[1]) -> Column:
    """1 if any character falls in [lo, hi]; NULL or empty text → 0."""
    return F.when(text.isNull() | (text == ""), 0).when(text.rlike(f"[\\x{{{lo}}}-\\x{{{hi}}}]"), 1).otherwise(0)


def is_non_ascii(text: Column) -> Column:
    """G02."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), 1).otherwise(0)


def text_length(text: Column) -> Column:
    """Character count, NULL → 0."""
    return F.coalesce(F.length(text), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words, NULL → 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WHITESPACE_RUN)), F.lit(0)).cast("int")


def composite_key(*cols: Column) -> Column:
    """``a_b`` key; NULL parts are spelled 'null' (ours; pandas writes 'nan')."""
    return F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])


def title_cause(cause: Column) -> Column:
    """G05: 'water_logging' → 'Water Logging'."""
    return F.initcap(F.regexp_replace(cause, "_", " "))


def standardise_vehicle(veh: Column, display_map: dict) -> Column:
    """Display name → key via the fixed map, else lower-case with spaces → underscores; NULL → 'others'."""
    from ..sources.dims import literal_map
    mapped = F.coalesce(literal_map(display_map)[veh], veh)
    return F.coalesce(F.regexp_replace(F.lower(mapped), " ", "_"), F.lit("others"))
