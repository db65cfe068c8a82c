"""Similarity join of vectors: epsilon grid order on leading principal dimensions, recursive join of intervals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import partitions, written

BLOCK = 512      # vectors of a block: the leaf of the recursion
FAN = 8          # intervals that an interval is split into
LEADING = 8      # principal dimensions of the grid
SAMPLE = 4096    # vectors from which the principal dimensions are taken (any axes give the same links)


def principal_axes(rows: list[list[float]]) -> np.ndarray:
    """The leading principal directions of unit vectors, as rows."""
    x = np.array(rows, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, vectors = np.linalg.eigh(np.cov(x, rowvar=False).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    return vectors[:, ::-1][:, :LEADING].T


def usable(col) -> F.Column:
    """Not null, not empty, every component finite, not the zero vector."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(col.isNotNull() & (F.size(col) > 0) & finite & F.exists(col, lambda x: x != 0), F.lit(False))


def link_components(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str | None = "label") -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links`` (other vectors of the same label, not null, with a cosine of
    at least ``least``), ``component_id`` (smallest id reachable by links) and ``kept`` (id = component_id).

    Links are exact. Equal vectors collapse to one with a weight before any pair is made. The rest are sorted by
    their grid cells (side: the distance that belongs to ``least``) on the leading principal dimensions, cut into
    blocks, and intervals of blocks are joined recursively: a pair of intervals whose boxes lie further apart than
    that distance is dropped, others are split. A pair of blocks gives per vector one row, its number of links and
    a vector that it hangs together with, not its links.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id or label,
    link with nothing (``component_id`` is the id itself). Vectors of different lengths never link. Rows that
    repeat an id are one vertex. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), label.alias("label"))
    good = rows.filter(usable(F.col("vec")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    groups = written(good.groupBy("label", "vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "vectors")
    nodes = groups.withColumn("dim", F.size("vec"))
    sample = nodes.orderBy(F.xxhash64("vec")).limit(SAMPLE).select("dim", "vec").collect()
    by_dim: dict[int, list] = {}
    for d, v in sample:
        by_dim.setdefault(d, []).append(v)
    axes = spark.sparkContext.broadcast({d: principal_axes(v) for d, v in by_dim.items()})
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    side = eps or 1.0

    def project(parts):
        for b in parts:
            dims = np.asarray(b.column("dim"))
            vec = b.column("vec")
            grid = np.empty(len(dims), object)
            raw = np.empty(len(dims), object)
            flat, off = np.asarray(vec.flatten(), np.float64), np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack([flat[off[i]:off[i + 1]] for i in at])
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                ax = axes.value.get(int(d))
                p = unit @ ax.T if ax is not None else unit[:, :LEADING]
                cells = (np.floor(p / side) + 128).clip(0, 255).astype(np.uint8)
                for i, c, u, q in zip(at, cells, x, p):
                    grid[i], raw[i] = c.tobytes(), (q.tobytes(), u.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("dim"), pa.array(grid, pa.binary()), b.column("node"),
                                              b.column("n"), pa.array([r[0] for r in raw], pa.binary()), pa.array([r[1] for r in raw], pa.binary())],
                                             names=["label", "dim", "cell", "node", "n", "place", "vec"])

    kind = dict(groups.dtypes)
    ego = nodes.select("label", "dim", "node", "n", "vec").mapInArrow(
        project, f"label {kind['label']}, dim int, cell binary, node {kind['node']}, n long, place binary, vec binary")
    order = ["label", "dim", "cell", "node"]
    ego = ego.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def cut(parts):
        task, seq, held = TaskContext.get().partitionId(), 0, []

        def block():
            nonlocal seq, held
            place = [np.frombuffer(r["place"], np.float64) for r in held]
            lo, hi = np.min(place, 0), np.max(place, 0)
            wide = lambda x: x.tolist() + [0.0] * (LEADING - len(x))
            got = {"block": (task << 24) + seq, "label": held[0]["label"], "dim": held[0]["dim"], "lo": wide(lo), "hi": wide(hi),
                   "nodes": [r["node"] for r in held], "ns": [r["n"] for r in held], "vecs": b"".join(r["vec"] for r in held)}
            held, seq = [], seq + 1
            return got
        for b in parts:
            out = []
            for r in b.to_pylist():
                if held and (len(held) == BLOCK or (held[0]["label"], held[0]["dim"]) != (r["label"], r["dim"])):
                    out.append(block())
                held.append(r)
            if out:
                yield out
        if held:
            yield [block()]

    block_schema = (f"block long, label {kind['label']}, dim int, lo array<double>, hi array<double>, nodes array<{kind['node']}>, "
                    "ns array<long>, vecs binary")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(block_schema))
    blocks = written(ego.mapInArrow(lambda parts: (pa.RecordBatch.from_pylist(r, arrow) for r in cut(parts)), block_schema), "blocks")

    pairs = _join_intervals(blocks, eps)
    out_schema = f"node {kind['node']}, links long, partner {kind['node']}"
    out_arrow = to_arrow_schema(StructType.fromDDL(out_schema))

    def compare(parts):
        for b in parts:
            for r in b.to_pylist():
                x, y = (np.frombuffer(r[k], np.float64).reshape(-1, r["dim"]) for k in ("vecs", "vecs2"))
                x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
                linked = x @ y.T >= least
                same = r["block"] == r["block2"]
                if same:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                ids = r["nodes"] if same else r["nodes"] + r["nodes2"]
                if same:
                    counts = linked @ np.array(r["ns"])
                    full = linked
                else:
                    counts = np.concatenate([linked @ np.array(r["ns2"]), linked.T @ np.array(r["ns"])])
                    full = np.zeros((len(ids), len(ids)), bool)
                    full[:len(x), len(x):] = linked
                    full |= full.T
                root = _roots(full)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], out_arrow.types[0]), pa.array(counts[at].astype(np.int64)),
                                                  pa.array([ids[root[i]] for i in at], out_arrow.types[2])], schema=out_arrow)

    left = blocks.select("block", "dim", "nodes", "ns", "vecs")
    right = blocks.select(F.col("block").alias("block2"), F.col("nodes").alias("nodes2"), F.col("ns").alias("ns2"), F.col("vecs").alias("vecs2"))
    found = written(pairs.join(left, "block").join(right, "block2").mapInArrow(compare, out_schema), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("u"), F.col("partner").alias("v")))
    known = groups.join(links, "node", "left").join(parts, "node", "left").select(
        "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"))
    joined = rows.withColumn("ok", usable(F.col("vec")) & F.col("id").isNotNull()).withColumn("vec", F.when(F.col("ok"), F.col("vec")))
    out = joined.join(known, ["label", "vec"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index that hangs together with each index of a symmetric matrix."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(root)).min(1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _join_intervals(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs (block, block2), block <= block2, of one label and length whose boxes are within ``eps``.

    The blocks of a label are a sequence; level l has intervals of FAN ** l of them. Starting with each sequence
    against itself, a level keeps the pairs of intervals that are near and splits them into the next level's."""
    dims = range(LEADING)
    leaf = blocks.select("block", "label", "dim", *[F.col("lo")[i].alias(f"lo{i}") for i in dims], *[F.col("hi")[i].alias(f"hi{i}") for i in dims])
    place = F.row_number().over(Window.partitionBy("label", "dim").orderBy("block")) - 1    # one row a block
    leaf = written(leaf.withColumn("pos", place), "intervals")
    most = leaf.agg(F.max("pos")).first()[0] or 0
    levels, spans = [leaf], 1
    while most // spans:
        spans *= FAN
        up = levels[-1].groupBy("label", "dim", F.floor(F.col("pos") / FAN).cast("int").alias("pos")).agg(
            *[F.min(f"lo{i}").alias(f"lo{i}") for i in dims], *[F.max(f"hi{i}").alias(f"hi{i}") for i in dims])
        levels.append(up)
    near = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"x.lo{i}") - F.col(f"y.hi{i}"), F.col(f"y.lo{i}") - F.col(f"x.hi{i}")), F.lit(2.0))
                for i in dims), F.lit(0.0)) <= eps * eps
    pairs = levels[-1].select("label", "dim", F.col("pos").alias("a"), F.col("pos").alias("b"))
    for level in reversed(levels[:-1]):
        child = level.withColumn("up", F.floor(F.col("pos") / FAN).cast("int"))
        x, y, p = child.alias("x"), child.alias("y"), pairs.alias("p")
        at = lambda s, side: (F.col(f"{s}.label") == F.col("p.label")) & (F.col(f"{s}.dim") == F.col("p.dim")) & (F.col(f"{s}.up") == F.col(f"p.{side}"))
        pairs = p.join(x, at("x", "a")).join(y, at("y", "b")).filter((F.col("x.pos") <= F.col("y.pos")) & near).select(
            F.col("p.label").alias("label"), F.col("p.dim").alias("dim"), F.col("x.pos").alias("a"), F.col("y.pos").alias("b"))
    a = leaf.select("label", "dim", F.col("pos").alias("a"), "block")
    b = leaf.select("label", "dim", F.col("pos").alias("b"), F.col("block").alias("block2"))
    return written(pairs.join(a, ["label", "dim", "a"]).join(b, ["label", "dim", "b"]).select("block", "block2"), "pairs")
