"""Density clustering (L09, J07): the reference's DBSCAN (eps 0.01°, min 5 incl. self, noise −1) as DataFrame jobs.

No pair of points is emitted inside a dense area:

1. Equal coordinates collapse into one weighted point (one aggregate).
2. Points are keyed by sub-cells of side eps / m. A neighbouring sub-cell offset is classified once by geometry:
   *full* when every point pair of the two sub-cells is within eps (their whole weight counts, a cell-level
   join), *rim* when some pairs may be, or beyond reach. At rim offsets a point meets cells that are cut into quadrants
   along the rim of its disk (``disk_reach``), so k points in a dense sub-cell cost far fewer than k² rows.
3. Core points (neighbour weight ≥ min_samples) are grouped by sub-cell: all core points of a sub-cell are
   mutually within eps (the self offset is full), so components are computed over sub-cells. Edges come from full
   offsets with cores on both sides and from rim offsets where any core pair is within eps; components come from randomised
   contraction (``graph.connected_components``), which ends when no edge is left, after O(log n) rounds.
4. Border points take the smallest neighbouring core label; clusters are renumbered 0.. in order of their
   smallest core row id (the order a sequential scan discovers them); everything else is −1.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .graph import connected_components

SUBCELLS_PER_EPS = 4


def offset_classes(m: int = SUBCELLS_PER_EPS) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(full, rim) sub-cell offsets for sub-cells of side eps / m (margins keep float edge cases on the rim)."""
    full, rim = [], []
    r = m + 1
    for dx in range(-r, r + 1):
        for dy in range(-r, r + 1):
            ax, ay = abs(dx), abs(dy)
            far = math.hypot(ax + 1, ay + 1) / m          # farthest pair, in units of eps
            near = math.hypot(max(ax - 1, 0), max(ay - 1, 0)) / m
            if far <= 1 - 1e-9:
                full.append((dx, dy))
            elif near <= 1 + 1e-9:
                rim.append((dx, dy))
    return full, rim


def _offsets(offs):
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offs])


def weighted_points(df: DataFrame, eps: float, lat: str = "latitude", lon: str = "longitude",
                    id_col: str = "id", m: int = SUBCELLS_PER_EPS) -> DataFrame:
    s = eps / m
    d = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    p = d.groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(F.count(F.lit(1)).alias("w"),
                                                                         F.min(id_col).alias("pid"))
    return (p.withColumn("cx", F.floor(F.col("lon") / s).cast("long"))
             .withColumn("cy", F.floor(F.col("lat") / s).cast("long")))


def _dist(a_lat, a_lon, b_lat, b_lon):
    return F.sqrt((F.col(a_lat) - F.col(b_lat)) * (F.col(a_lat) - F.col(b_lat))
                  + (F.col(a_lon) - F.col(b_lon)) * (F.col(a_lon) - F.col(b_lon)))


def _shift(df: DataFrame, offs, cols) -> DataFrame:
    """Each row once per offset, keyed by the shifted sub-cell (tx, ty)."""
    e = df.select(*cols, F.explode(_offsets(offs)).alias("o"))
    return e.select(*cols, (F.col("cx") + F.col("o.dx")).alias("tx"), (F.col("cy") + F.col("o.dy")).alias("ty"))


LEAF = 16         # points of a cell that are tested one by one


def disk_reach(probe: DataFrame, points: DataFrame, eps: float, s: float, first: bool = False, log: list | None = None) -> DataFrame:
    """Weight of ``points`` within eps of each probe's point, in the cell (tx, ty) that the probe names: rows (key, w) to be
    summed by key. With ``first`` only whether there is any: each key that has one comes at least once.

    A cell has the bounding box of its points. If the box lies wholly in the probe's disk its weight counts, if wholly
    beyond it does not; otherwise a cell of at most LEAF points is tested point by point, a larger one is cut into its
    four quadrants and the probe goes on there. So a probe meets the cells along the rim of its disk, not all points of
    a dense cell. Distances to box sides are computed as those to points are, and rounding keeps their order, so the
    answer is exact. Distinct points end up in cells of their own, which ends the cutting. With ``first`` a key that has
    found a point asks no further. ``log`` receives the number of rows of each level.
    """
    level, out = 0, []
    while True:
        scale = float(1 << level)
        at = points.select("lat", "lon", "w", F.floor(F.col("lon") / s * scale).cast("long").alias("tx"),
                           F.floor(F.col("lat") / s * scale).cast("long").alias("ty"))
        cells = at.groupBy("tx", "ty").agg(F.sum("w").alias("W"), F.count(F.lit(1)).alias("n"), F.min("lat").alias("la0"), F.max("lat").alias("la1"),
                                           F.min("lon").alias("lo0"), F.max("lon").alias("lo1"))
        j = probe.join(cells, ["tx", "ty"])

        def side(x, lo, hi):
            return (F.greatest(F.col(lo) - F.col(x), F.col(x) - F.col(hi), F.lit(0.0)),
                    F.greatest(F.abs(F.col(x) - F.col(lo)), F.abs(F.col(x) - F.col(hi))))
        (ny, fy), (nx, fx) = side("lat", "la0", "la1"), side("lon", "lo0", "lo1")
        j = j.withColumn("__far", F.sqrt(fy * fy + fx * fx)).filter(F.sqrt(ny * ny + nx * nx) <= eps)
        kind = F.when(F.col("__far") <= eps, "in").when(F.col("n") <= LEAF, "leaf").otherwise("cut")
        j = written(j.select("key", "lat", "lon", "tx", "ty", "W", kind.alias("kind")), "reach")
        leaf = j.filter("kind = 'leaf'").select("key", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), "tx", "ty").join(at, ["tx", "ty"])
        found = j.filter("kind = 'in'").select("key", F.col("W").alias("w")).unionAll(
            leaf.filter(_dist("qlat", "qlon", "lat", "lon") <= eps).select("key", "w"))
        if log is not None:
            log.append(j.count() + leaf.count())
        probe = j.filter("kind = 'cut'").select("key", "lat", "lon", "tx", "ty")
        if first:
            found = written(found.select("key", F.lit(1).alias("w")).distinct(), "found")
            probe = probe.join(found.select("key"), "key", "left_anti")
        out.append(found)
        if j.filter("kind = 'cut'").isEmpty():
            return functools.reduce(DataFrame.unionAll, out)
        quads = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
        probe = probe.withColumn("o", F.explode(quads)).select("key", "lat", "lon", (2 * F.col("tx") + F.col("o.a")).alias("tx"),
                                                               (2 * F.col("ty") + F.col("o.b")).alias("ty"))
        level += 1


def core_points(points: DataFrame, eps: float = 0.01, min_samples: int = 5,
                m: int = SUBCELLS_PER_EPS) -> DataFrame:
    """Neighbour weight (self included) and core flag per weighted point."""
    full, rim = offset_classes(m)
    cells = points.groupBy("cx", "cy").agg(F.sum("w").alias("W"))
    fw = (_shift(cells, full, ["cx", "cy"])
          .join(cells.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), "W"), ["tx", "ty"])
          .groupBy("cx", "cy").agg(F.sum("W").alias("full_w")))
    probe = _shift(points, rim, ["pid", "lat", "lon", "cx", "cy"]).select(F.col("pid").alias("key"), "lat", "lon", "tx", "ty")
    rw = disk_reach(probe, points, eps, eps / m).groupBy(F.col("key").alias("pid")).agg(F.sum("w").alias("rim_w"))
    pts = points.join(fw, ["cx", "cy"], "left").join(rw, "pid", "left")
    n = (F.coalesce(F.col("full_w"), F.lit(0)) + F.coalesce(F.col("rim_w"), F.lit(0))).cast("long")
    return pts.withColumn("neighbour_count", n).withColumn("is_core", n >= min_samples).drop("full_w", "rim_w")


def neighbour_counts(df: DataFrame, eps: float = 0.01, min_samples: int = 5, lat: str = "latitude",
                     lon: str = "longitude", id_col: str = "id") -> DataFrame:
    """Per row, the weight of rows within eps (self included) and the core flag; NULL coordinates → NULL."""
    pts = core_points(weighted_points(df, eps, lat, lon, id_col), eps, min_samples)
    return df.join(pts.select(F.col("lat").alias(lat), F.col("lon").alias(lon), "neighbour_count", "is_core"),
                   [lat, lon], "left")


def dbscan(df: DataFrame, eps: float = 0.01, min_samples: int = 5, lat: str = "latitude", lon: str = "longitude",
           id_col: str = "id", m: int = SUBCELLS_PER_EPS) -> DataFrame:
    """``id_col``, ``geo_cluster`` for every row (−1 for noise and NULL coordinates)."""
    full, rim = offset_classes(m)
    pts = written(core_points(weighted_points(df, eps, lat, lon, id_col, m), eps, min_samples, m), "points")
    core = pts.filter("is_core")
    ccells = core.groupBy("cx", "cy").agg(F.min("pid").alias("label"))          # one node per core sub-cell
    node = ccells.select("cx", "cy")
    e_full = (_shift(node, full, ["cx", "cy"]).join(node.select(F.col("cx").alias("tx"), F.col("cy").alias("ty")),
                                                   ["tx", "ty"]).select("cx", "cy", "tx", "ty"))
    half = [(dx, dy) for dx, dy in rim if (dx, dy) > (0, 0)]                    # an edge is found from one of its ends
    pair = F.struct("cx", "cy", F.col("tx").alias("ox"), F.col("ty").alias("oy")).alias("key")
    probe = _shift(core, half, ["lat", "lon", "cx", "cy"]).select(pair, "lat", "lon", "tx", "ty")
    rp = disk_reach(probe, core, eps, eps / m, first=True).select("key.cx", "key.cy", F.col("key.ox").alias("tx"), F.col("key.oy").alias("ty"))
    edges = e_full.unionByName(rp).distinct()
    parts = connected_components(edges.select(F.struct("cx", "cy").alias("u"), F.struct(F.col("tx").alias("cx"), F.col("ty").alias("cy")).alias("v")))
    cells = ccells.withColumn("node", F.struct("cx", "cy")).join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node")).drop("node")
    least = cells.groupBy("component").agg(F.min("label").alias("least"))
    labels = written(cells.join(least, "component").select("cx", "cy", F.col("least").alias("label")), "labels")
    # clusters renumbered by their smallest core row id (one row per cluster in the window)
    # the label of a component is its smallest core pid, so ranking labels renumbers clusters in discovery
    # order; the rank is a distributed running count (the cluster count grows with the data)
    from .stats import running_total
    comps = labels.select("label").distinct().withColumn("__one", F.lit(1))
    cid = running_total(comps, "label", "__one", "__c").select("label", (F.col("__c") - 1).alias("cid"))
    cell_cid = labels.join(cid, "label").select("cx", "cy", "cid")
    core_lab = core.join(cell_cid, ["cx", "cy"]).select("pid", "cid")
    # border points: smallest cluster among full-offset core cells and rim core points within eps
    nonc = pts.filter(~F.col("is_core"))
    bf = (_shift(nonc, full, ["pid", "cx", "cy"])
          .join(cell_cid.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), "cid"), ["tx", "ty"])
          .select("pid", "cid"))
    cell = F.struct("pid", F.col("tx").alias("ox"), F.col("ty").alias("oy")).alias("key")
    probe = _shift(nonc, rim, ["pid", "lat", "lon", "cx", "cy"]).select(cell, "lat", "lon", "tx", "ty")
    hit = disk_reach(probe, core, eps, eps / m, first=True)
    br = (hit.select("key.pid", F.col("key.ox").alias("tx"), F.col("key.oy").alias("ty")).join(cell_cid.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), "cid"), ["tx", "ty"])
          .select("pid", "cid"))
    border = bf.unionByName(br).groupBy("pid").agg(F.min("cid").alias("cid"))
    point_lab = core_lab.unionByName(border)
    pl = pts.join(point_lab, "pid", "left").select(F.col("lat").alias(lat), F.col("lon").alias(lon),
                                                   F.coalesce("cid", F.lit(-1)).cast("int").alias("geo_cluster"))
    out = df.select(id_col, lat, lon).join(pl, [lat, lon], "left")
    return out.select(id_col, F.coalesce("geo_cluster", F.lit(-1)).cast("int").alias("geo_cluster"))
