"""Row-level scoring rules (F01–F20). Native Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dims import (HIGH_SEVERITY_CAUSES, MEDIUM_SEVERITY_CAUSES, SEVERITY_MAPS,
                            literal_map)


def clip(x: Column, lo, hi) -> Column:
    """F01."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def risk_class(score: Column, bounds=(75, 50, 25)) -> Column:
    """Critical ≥ b0, High ≥ b1, Medium ≥ b2, else Low (NULL score → Low as in the reference)."""
    c, h, m = bounds
    return (F.when(score >= c, "Critical").when(score >= h, "High").when(score >= m, "Medium")
            .otherwise("Low"))


def impact_score_v2(dur: Column, closure: Column, tier: Column, peak: Column) -> Column:
    """F15 (code label): clip(dur/10, 0, 40) + 30·closure + 5·tier + 15·peak, clipped to 0–100.

    Note T3: tier *adds* 5·tier, so tier 3 corridors get more points than tier 1; kept as written.
    """
    return clip(clip(dur / 10, 0, 40) + closure * 30 + tier * 5 + peak * 15, 0, 100)


def impact_score_v1(dur: Column, closure: Column, tier: Column) -> Column:
    """F16 (documented label): 50·closure + tier {1:30, 2:22, 3:14, else 0} + duration {>6h 20, >2h 14, >1h 7}."""
    tier_pts = F.when(tier == 1, 30).when(tier == 2, 22).when(tier == 3, 14).otherwise(0)
    dur_pts = F.when(dur > 360, 20).when(dur > 120, 14).when(dur > 60, 7).otherwise(0)
    return clip(closure * 50 + tier_pts + dur_pts, 0, 100)


def cause_severity(cause: Column, variant: str = "base") -> Column:
    """severity points of a cause with the variant's default."""
    m, default = SEVERITY_MAPS[variant]
    return F.coalesce(literal_map(m)[cause], F.lit(default))


def cause_cluster(cause: Column) -> Column:
    """3 high, 2 medium, 1 otherwise."""
    return (F.when(cause.isin(*HIGH_SEVERITY_CAUSES), 3)
            .when(cause.isin(*MEDIUM_SEVERITY_CAUSES), 2).otherwise(1))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """great-circle distance, R = 6371 km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2 - lat1)
    dl = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(6371.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def travel_minutes(km: Column, speed_kmh: float = 30.0) -> Column:
    """int(km / speed · 60), truncating."""
    return (km / speed_kmh * 60).cast("int")


def affected_area(radius_km: float = 2.0) -> Column:
    """π·r²."""
    return F.pi() * F.lit(radius_km) * F.lit(radius_km)


def congestion_speed(congestion: Column) -> Column:
    """max(10, 60 − 0.5·congestion)."""
    return F.greatest(F.lit(10.0), 60 - 0.5 * congestion)


def crowd_tier(crowd: Column) -> Column:
    """0 ≤10 000, 1 ≤30 000, 2 ≤50 000, else 3."""
    return F.when(crowd <= 10000, 0).when(crowd <= 30000, 1).when(crowd <= 50000, 2).otherwise(3)


def rain_risk(rain_mm: Column) -> Column:
    """strict thresholds >50 Critical, >25 High, >10 Medium, else Low."""
    return (F.when(rain_mm > 50, "Critical").when(rain_mm > 25, "High").when(rain_mm > 10, "Medium")
            .otherwise("Low"))


def nan_to_null(x: Column) -> Column:
    """NaN / ±inf → NULL."""
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(x)


def round_half(x: Column, digits: int = 1) -> Column:
    """Display rounding of the reference (``round(x, 1)``) made engine-stable: a 1e-9 nudge away from zero
    decides exact decimal ties the same way in Spark and SQL engines (Python would use half-even on the
    binary value; only exact ties can differ)."""
    return F.round(x + F.lit(1e-9) * F.signum(x), digits)


def data_quality_flags(endlat: Column, endlon: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """``has_end_coords`` (both end coordinates ≠ 0; a NULL compares as true, as in pandas) and
    ``coords_complete`` (all four non-NULL)."""
    has_end = F.coalesce(endlat != 0, F.lit(True)) & F.coalesce(endlon != 0, F.lit(True))
    complete = lat.isNotNull() & lon.isNotNull() & endlat.isNotNull() & endlon.isNotNull()
    return has_end.cast("int"), complete.cast("int")


# FIXED VALUES: mean and standard deviation of the noise in each candidate target.
TARGET_NOISE = {"v1": (15.0, 6.0), "v2": (8.0, 4.0), "v3": (12.0, 5.0), "m4": (10.0, 4.5), "m5": (7.0, 3.5), "m6": (9.0, 4.0)}


def hash_uniform(key: Column, stream: str, second: bool = False) -> Column:
    """A uniform draw in (0, 1) that depends on ``key`` and ``stream`` alone: 52 bits of an MD5 (``second``: 52 others).
    The same row has the same draw under any partitioning, on every run, and in any engine with MD5."""
    digest = F.md5(F.concat(F.lit(f"{stream}:"), key.cast("string")))
    return (F.conv(F.substring(digest, 14 if second else 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def gauss(key: Column, stream: str, mean: float = 0.0, sd: float = 1.0) -> Column:
    """A normal draw of the same kind, by Box–Muller from the two uniforms."""
    turn = F.cos(F.lit(2.0) * F.pi() * hash_uniform(key, stream, True))
    return F.lit(mean) + F.lit(sd) * F.sqrt(F.lit(-2.0) * F.log(hash_uniform(key, stream))) * turn


def hash_poisson(key: Column, stream: str, rate: Column) -> Column:
    """A Poisson draw of a rate of at most 1, by inversion: below 2^-52 the chance of 20 or more cannot be told from 0."""
    u, none = hash_uniform(key, stream), F.exp(-rate)

    def step(a, k):                                        # one more chance of exactly k: P(k) = P(k - 1) rate / k
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["below"] + p).alias("below"), (a["w"] + (u >= a["below"]).cast("int")).alias("w"))
    start = F.struct(none.alias("p"), none.alias("below"), F.lit(0).alias("w"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, step, lambda a: a["w"])



def target_formulas(c: Column, t: Column, pk: Column, wk: Column, ti: Column, ts: Column, cause: Column,
                    has_script: Column, desc_len: Column, temporal_pct: Column, desc_pct: Column,
                    noise_key: Column | None = None) -> dict[str, Column]:
    """The six candidate training targets (trials v1–v3, methods m4–m6), with their Gaussian noise (``gauss``
    of ``noise_key``) if a key is given, each clipped to 0–100. Inputs: closure, tier, peak, weekend, intensity, temporal score, cause, script
    flag, description length and the two percentile ranks (E07)."""
    ct = c * t
    v1 = c * 55 + t * 12 + ct * 10 + pk * 7
    v2 = (cause_severity(cause, "t2") * 1.5 + c * 35 + t * 10 + pk * 8 + wk * -4 + has_script * 3 + ts * 15)
    v3 = c * 50 + F.pow(t, 1.5) * 8 + F.pow(ti, 2) * 12 + ct * 15 + pk * t * 6 + F.log1p(desc_len) * 2
    m4 = (cause_cluster(cause) * 18 + F.pow(c, 1.2) * 42 + F.pow(t, 1.3) * 9 + F.exp(ts) * 5 + pk * 6
          + has_script * 2.5 + F.log1p(desc_len) * 1.5)
    m5 = (cause_severity(cause, "m5") * 0.8 + c * 40 * 1.1 + (t / 3 * 25) * 0.9 + temporal_pct * 20
          + desc_pct * 10 * 0.5 + has_script * 3.5 + pk * 5)
    m6 = (cause_severity(cause, "m6") * 1.3 + c * 32 + t * 11 + ct * 12 + ct * ts * 8 + c * pk * t * 4 + ts * 14
          + has_script * t * 2 + ti * t * 3 + pk * 7 + wk * -3)
    plain = {"v1": v1, "v2": v2, "v3": v3, "m4": m4, "m5": m5, "m6": m6}
    if noise_key is not None:
        plain = {k: v + gauss(noise_key, k, *TARGET_NOISE[k]) for k, v in plain.items()}
    return {k: clip(v.cast("double"), 0.0, 100.0) for k, v in plain.items()}
