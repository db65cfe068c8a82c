"""Exact top-k inner products by a pivot-distance index: sorted annuli, triangle-inequality bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

BLOCK, ASKED = 1024, 256   # vectors of a block of the index, queries of a block of queries
TILE = 64                  # blocks of queries that share one copy of a block of the index
STEPS = (1, 4, 16, None)   # annuli that a block of queries searches in each round; in the last all that are left in reach
LOWEST = -2**62            # below all scores
PIVOTS, SAMPLE = 64, 4096  # pivots, and the vectors they are chosen from (any pivots give the same result)


def pick_pivots(x: np.ndarray, k: int) -> np.ndarray:
    """Means of a few rounds of k-means from farthest-first seeds."""
    seeds = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(seeds) < min(k, len(x)) and far.max() > 0:
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(1))
    c = x[seeds].astype(np.float64)
    for _ in range(5):
        near = (((x * x).sum(1)[:, None] - 2 * x @ c.T) + (c * c).sum(1)).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of (x, extra) to the pivots, which have one dimension more than x."""
    full = np.column_stack([x, extra])
    d = (full * full).sum(1)[:, None] - 2 * full @ pivots.T + (pivots * pivots).sum(1)
    return np.sqrt(np.maximum(d, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while no sum can leave 2 ** 53, else in 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of every query (ids divisible by ``every``) with all other rows:
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller id; exact.

    A component is floor(scale * x). With one more coordinate that gives all vectors the same norm, a higher product
    is a smaller Euclidean distance. Vectors are keyed by nearest pivot and distance, sorted and cut into blocks,
    each an annulus around its pivot. Blocks of queries search annuli in the order of their distance, in rounds: the
    k-th score found so far bounds how far a better one can lie, and by the triangle inequality only annuli that reach
    into that distance are searched. A block of the index travels once to each tile of queries; a pair of blocks gives
    at most k rows a query, none below its bound.

    Null, empty or non-finite vectors and null ids take no part, zero vectors do. Only vectors of one length are
    compared. A query with fewer than k others returns all. Products must fit 64 bits.
    """
    spark = vectors.sparkSession
    col = F.col(vec_col)
    fine = F.coalesce(F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(col) > 0), F.lit(False))
    ints = F.transform(col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.filter(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), ints.alias("vec"))
    rows = rows.withColumn("dim", F.size("vec"))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    most = {r[0]: r[1] for r in rows.groupBy("dim").agg(F.max(norm)).collect()}       # one row a length
    by_dim: dict[int, list] = {}
    for d, v in rows.select("dim", "vec").orderBy(F.xxhash64("vec"), "id").limit(SAMPLE).collect():
        by_dim.setdefault(d, []).append(v)

    def lift(x, dim):
        return np.sqrt(np.maximum(most[dim] - (x.astype(np.float64) ** 2).sum(1), 0))

    pivots = {d: pick_pivots(np.column_stack([np.array(v, np.float64), lift(np.array(v), d)]), PIVOTS) for d, v in by_dim.items()}
    for d in most:
        pivots.setdefault(d, np.zeros((1, d + 1)))
    shared = spark.sparkContext.broadcast((pivots, most))

    def keyed(asked: bool):
        def run(parts):
            pv, top = shared.value
            for b in parts:
                dims, ids = np.asarray(b.column("dim")), b.column("id")
                flat, off = np.asarray(b.column("vec").flatten()), np.concatenate([[0], np.cumsum(dims)])
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    x = np.stack([flat[off[i]:off[i + 1]] for i in at])
                    extra = np.zeros(len(x)) if asked else np.sqrt(np.maximum(top[int(d)] - (x.astype(np.float64) ** 2).sum(1), 0))
                    dist = distances(x, extra, pv[int(d)])
                    near = dist.argmin(1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), d, np.int32)), pa.array(near.astype(np.int32)), pa.array(dist[np.arange(len(x)), near]),
                        ids.take(pa.array(at)), pa.array([v.astype("<i8").tobytes() for v in x], pa.binary())],
                        names=["dim", "pivot", "dist", "id", "vec"])
        return run

    def cut(size: int):
        def run(parts):
            task, seq, held = TaskContext.get().partitionId(), 0, []

            def block():
                nonlocal held, seq
                row = {"block": (task << 24) + seq, "dim": held[0]["dim"], "pivot": held[0]["pivot"], "near": held[0]["dist"],
                       "far": held[-1]["dist"], "ids": [r["id"] for r in held], "vecs": b"".join(r["vec"] for r in held)}
                held, seq = [], seq + 1
                return pa.RecordBatch.from_pylist([row], arrow)
            for b in parts:
                for r in b.to_pylist():
                    if held and (len(held) == size or (held[0]["dim"], held[0]["pivot"]) != (r["dim"], r["pivot"])):
                        yield block()
                    held.append(r)
            if held:
                yield block()
        return run

    arrow = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("pivot", pa.int32()), ("near", pa.float64()),
                       ("far", pa.float64()), ("ids", pa.list_(pa.int64())), ("vecs", pa.binary())])
    ddl = "block long, dim int, pivot int, near double, far double, ids array<long>, vecs binary"
    order = ["dim", "pivot", "dist", "id"]

    def index(df, asked, size):
        key = df.mapInArrow(keyed(asked), "dim int, pivot int, dist double, id long, vec binary")
        return written(key.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(cut(size), ddl), "annuli")

    base = index(rows, False, BLOCK)
    asked = index(rows.filter(F.pmod("id", F.lit(every)) == 0), True, ASKED).select(
        F.col("block").alias("q"), "dim", F.col("ids").alias("qids"), F.col("vecs").alias("qvecs"))
    annuli = base.select("block", "dim", "pivot", "near", "far")
    tiles = max(1, asked.count() // TILE)
    queries = asked.withColumn("tau", F.transform("qids", lambda _: F.lit(LOWEST).cast("long")))

    def reach(parts):
        """For a block of queries and each pivot: their distances to it, and between what distances a better score can lie."""
        pv, top = shared.value
        for b in parts:
            out = []
            for r in b.to_pylist():
                x = np.frombuffer(r["qvecs"], "<i8").reshape(-1, r["dim"]).astype(np.float64)
                t = np.array(r["tau"], np.float64)
                far = np.sqrt(np.maximum((x * x).sum(1) + top[r["dim"]] - 2 * t, 0)) * (1 + 1e-9) + 1e-3
                d = distances(x, np.zeros(len(x)), pv[r["dim"]])
                out += [{"q": r["q"], "dim": r["dim"], "pivot": p, "from": float(d[:, p].min()), "to": float(d[:, p].max()),
                         "lo": float(np.min(d[:, p] - far)), "hi": float(np.max(d[:, p] + far))} for p in range(d.shape[1])]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("q", pa.int64()), ("dim", pa.int32()), ("pivot", pa.int32()), ("from", pa.float64()),
                                                             ("to", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64())]))

    def search(parts):
        """The best scores of blocks of queries with a block of the index, which comes before them, once a tile."""
        ids, x = None, None
        for b in parts:
            for r in b.to_pylist():
                vecs = np.frombuffer(r["vecs"], "<i8").reshape(-1, r["dim"])
                if r["tau"] is None:
                    ids, x = np.array(r["ids"]), vecs
                    continue
                qids, tau = np.array(r["ids"]), np.array(r["tau"])
                s = products(vecs, x)
                hit = (s >= tau[:, None]) & (qids[:, None] != ids[None, :])
                rows_, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in np.flatnonzero(hit.any(1)):
                    c = np.flatnonzero(hit[i])
                    if len(c) > k:
                        c = c[np.lexsort((ids[c], -s[i, c]))[:k]]
                    rows_.append(np.full(len(c), i))
                    cols.append(c)
                i, c = np.concatenate(rows_), np.concatenate(cols)
                yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(ids[c]), pa.array(s[i, c])], names=["query_id", "vec_id", "score"])

    def best(found):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    columns = ["block", "tile", "q", "dim", "ids", "vecs", "tau"]
    found, seen = None, None
    for take in STEPS:
        ranges = queries.mapInArrow(reach, "q long, dim int, pivot int, `from` double, to double, lo double, hi double")
        pairs = ranges.join(annuli, ["dim", "pivot"]).filter("far >= lo and near <= hi")
        if seen is not None:
            pairs = pairs.join(seen, ["q", "block"], "left_anti")
        if take:                                                  # annuli in the order of their least distance
            gap = F.greatest(F.col("near") - F.col("to"), F.col("from") - F.col("far"), F.lit(0.0))
            middle = F.abs(F.col("near") + F.col("far") - F.col("from") - F.col("to"))
            order = F.row_number().over(Window.partitionBy("q").orderBy(gap, middle, "block"))
            pairs = pairs.withColumn("order", order).filter(F.col("order") <= take)
        pairs = written(pairs.select("q", "block", F.pmod("q", F.lit(tiles)).alias("tile")), "pairs")
        seen = pairs.select("q", "block") if seen is None else seen.unionAll(pairs.select("q", "block"))
        asks = pairs.join(queries, "q").select("block", "tile", "q", "dim", F.col("qids").alias("ids"), F.col("qvecs").alias("vecs"), "tau")
        held = pairs.select("block", "tile").distinct().join(base, "block")
        held = held.withColumn("q", F.lit(-1).cast("long")).withColumn("tau", F.lit(None).cast("array<long>"))
        both = held.select(columns).unionAll(asks.select(columns)).repartition(partitions(spark), "block", "tile")
        new = both.sortWithinPartitions("block", "tile", "q").mapInArrow(search, "query_id long, vec_id long, score long")
        found = written(best(new if found is None else found.unionAll(new)).drop("rank"), "found")
        if take:
            kth = found.groupBy("query_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
            each = queries.select("q", F.posexplode("qids").alias("i", "query_id")).join(kth, "query_id", "left")
            bound = F.struct("i", F.coalesce("score", F.lit(LOWEST)).alias("t"))
            tau = each.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(bound)), lambda z: z["t"]).alias("tau"))
            queries = written(queries.drop("tau").join(tau, "q"), "queries")
    return best(found).select("query_id", "rank", "vec_id", "score")
