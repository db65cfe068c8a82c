"""Exact k-means on integer vectors with Hamerly's bounds, loosened by geometric drift instead of full drift."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, partitions, written

BLOCK = 1024            # vectors of a block
MOST = 1 << 27          # greatest size of a component: 64 squared differences still fit 64 bits
SLACK = 1e-6            # margin of the bounds, kept as doubles, against rounding; what it leaves open is scanned

STATE = [("ids", pa.list_(pa.int64())), ("vecs", pa.binary()), ("near", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()),
         ("moved", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))),
         ("radius", pa.list_(pa.float64())), ("scanned", pa.int64())]
DDL = ("ids array<long>, vecs binary, near binary, upper binary, lower binary, "
       "moved array<struct<cluster:int,n:long,sums:array<long>>>, radius array<double>, scanned long")


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (n x k) of integer vectors: in doubles while nothing can leave 2 ** 53, else in integers."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4.0 * float(top) ** 2 * max(x.shape[1], 1) < 2**53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - row) ** 2).sum(1) for row in c.astype(np.int64)], 1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster by how much the distance of any of its vectors to any other centroid can have fallen.

    Take a cluster's sphere (old centroid a, radius r) and another centroid that moved from c to c' by p. In the
    plane of a, c and c', with m the middle of c and c', a vector x has d(x, c) - d(x, c') = 2 p u / (d + d'), where
    u is the projection of x - m on the direction of the move; d + d' is at least 2 |x - m|, so the difference is at
    most p times the cosine of the angle at m. The sphere lies in the cone of half angle asin(r / |a - m|) around a;
    the largest cosine in it is that of the angle less the half angle (1 if m is in the sphere, at least 0)."""
    k = len(old)
    out = np.zeros(k)
    move = (new - old).astype(np.float64)
    p = np.sqrt((move * move).sum(1))
    middle = (new + old) / 2.0
    for a in range(k):
        away = old[a] - middle
        d = np.sqrt((away * away).sum(1))
        for j in np.flatnonzero(p):
            if j == a:
                continue
            if d[j] <= radius[a]:
                fall = p[j]
            else:
                angle = np.arccos(np.clip((away[j] * move[j]).sum() / (d[j] * p[j]), -1, 1))
                fall = p[j] * max(0.0, np.cos(max(0.0, angle - np.arcsin(radius[a] / d[j]))))
            out[a] = max(out[a], fall)
    return out


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, distance to it, distance to the second nearest); ties go to the smaller number."""
    d = squared(x, c)
    near = d.argmin(1)
    first = np.sqrt(d[np.arange(len(d)), near].astype(np.float64))
    if d.shape[1] == 1:
        return near, first, np.full(len(d), np.inf)
    return near, first, np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))


def kept_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    col = F.col(vec_col)
    fine = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & (F.size(col) == dim)
    ints = F.transform(col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), ints.alias("vec"))
    wide = F.exists("vec", lambda x: F.abs(x) > MOST)
    bad = F.raise_error(F.lit(f"a component is beyond {MOST} / scale: squared distances would leave 64 bits"))
    return rows.select("id", F.when(wide, bad.cast("array<int>")).otherwise(F.col("vec").cast("array<int>")).alias("vec"))


def start_order(seed: str) -> list:
    """Order of the vectors of which the first become centroids; a null id counts as an empty text."""
    return [F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "vec"]


def total(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(change of the counts, change of the sums, radius of every cluster, vectors scanned) of a written state: partial
    sums by task, then k rows."""
    def run(parts):
        n, s, r, scanned = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k), 0
        for b in parts:
            for row in b.to_pylist():
                for c in row["moved"]:
                    n[c["cluster"]] += c["n"]
                    s[c["cluster"]] += np.array(c["sums"], np.int64)
                r = np.maximum(r, row["radius"])
                scanned += row["scanned"]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(s.tolist(), pa.list_(pa.int64())), pa.array(r),
                                          pa.array(np.full(k, scanned, np.int64))], names=["cluster", "n", "sums", "radius", "scanned"])

    part = state.select("moved", "radius", "scanned").mapInArrow(run, "cluster int, n long, sums array<long>, radius double, scanned long")
    got = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("r"), F.sum("scanned").alias("scanned"),
                                      F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums"))
    n, s, r, scanned = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k), 0
    for row in got.collect():                                                     # k rows
        n[row.cluster], s[row.cluster], r[row.cluster], scanned = row.n, row.sums, row.r, row.scanned
    return n, s, r, scanned


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:", id_col: str = "vec_id",
            vec_col: str = "embedding", log: list | None = None) -> DataFrame:
    """k-means of vectors turned into integers floor(scale * x): ``vec_id``, ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every vector; exact in integers.

    The first centroids are the ``k`` vectors whose ids have the smallest sha256 after ``seed``. Each of ``rounds``
    rounds assigns every vector to its nearest centroid (ties: smaller number) and moves each non-empty centroid to
    floor(sum / count); then vectors are assigned once more. When no centroid moves, the rounds left change nothing
    and are left out.

    A vector carries an upper bound of the distance to its centroid and a lower one of that to any other. After a
    move the upper bound grows by the drift of its centroid and the lower falls by its cluster's ``loosening``. While
    the upper stays below the lower, the vector stays; else the upper is measured, and what is still open is scanned
    against all centroids. Vectors lie in blocks, written with their bounds each round (the round before is removed);
    only vectors that change clusters are summed. The driver holds k centroids. ``log`` receives, per pass, the number
    of vectors that were scanned.

    Vectors that are null, of another length or hold null or non-finite components are left out. Rows that repeat an
    id are vectors of their own, equal ones are too; a null id counts as an empty text in the order of the hashes and
    stays null in the result. With fewer than ``k`` vectors each starts a centroid; an empty table gives an empty
    result. A component beyond 2 ** 27 is an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, dim, scale, id_col, vec_col)
    first = [r.vec for r in rows.orderBy(*start_order(seed)).limit(k).collect()]           # k vectors
    out_ddl = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out_ddl)
    new = np.array(first, np.int64).reshape(len(first), dim)
    k, schema = len(new), pa.schema(STATE)

    def row(ids, x, near, upper, lower, was, scanned):
        """A block as a row; ``was`` are the clusters before (-1: none)."""
        moved = []
        at = np.flatnonzero(near != was)
        for c in np.unique(np.concatenate([near[at], was[at]])):
            if c >= 0:
                plus, minus = x[at[near[at] == c]].astype(np.int64), x[at[was[at] == c]].astype(np.int64)
                moved.append({"cluster": int(c), "n": len(plus) - len(minus), "sums": (plus.sum(0) - minus.sum(0)).tolist()})
        radius = np.zeros(k)
        np.maximum.at(radius, near, upper)
        return {"ids": ids, "vecs": x.astype("<i4").tobytes(), "near": near.astype("<i4").tobytes(), "upper": upper.astype("<f8").tobytes(),
                "lower": lower.astype("<f8").tobytes(), "moved": moved, "radius": radius.tolist(), "scanned": scanned}

    def begin(centroids):
        def run(parts):
            for b in parts:
                for i in range(0, b.num_rows, BLOCK):
                    part = b.slice(i, BLOCK)
                    x = np.asarray(part.column(1).flatten()).reshape(-1, dim)
                    near, upper, lower = scan(x, centroids)
                    yield pa.RecordBatch.from_pylist([row(part.column(0).to_pylist(), x, near, upper, lower, np.full(len(x), -1), len(x))], schema)
        return run

    def go_on(centroids, drift, loose):
        def run(parts):
            for b in parts:
                for r in b.to_pylist():
                    x = np.frombuffer(r["vecs"], "<i4").reshape(-1, dim)
                    was = np.frombuffer(r["near"], "<i4").astype(np.int64)
                    near = was.copy()
                    upper, lower = np.frombuffer(r["upper"], "<f8") + drift[was], np.frombuffer(r["lower"], "<f8") - loose[was]
                    safe = upper + SLACK * (1 + upper) < lower
                    at = np.flatnonzero(~safe)
                    own = x[at].astype(np.int64) - centroids[was[at]]
                    upper[at] = np.sqrt((own * own).sum(1).astype(np.float64))
                    at = at[~(upper[at] + SLACK * (1 + upper[at]) < lower[at])]
                    if len(at):
                        near[at], upper[at], lower[at] = scan(x[at], centroids)
                    yield pa.RecordBatch.from_pylist([row(r["ids"], x, near, upper, lower, was, len(at))], schema)
        return run

    pick = rows.repartition(partitions(spark), F.xxhash64("id", "vec"))       # an even deal, the same on every run
    state = written(pick.mapInArrow(begin(new), DDL), "clusters")
    count, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    for _ in range(rounds):
        n, s, radius, scanned = total(state, k, dim)
        if log is not None:
            log.append(scanned)
        count, sums = count + n, sums + s
        old, new = new, np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], new)
        if (old == new).all():
            break
        drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
        loose = loosening(old, new, radius * (1 + 1e-9) + SLACK) * (1 + 1e-9) + 1e-9
        before, state = state, written(state.mapInArrow(go_on(new, drift, loose), DDL), "clusters")
        forget(before)

    def measured(parts):
        for b in parts:
            for r in b.to_pylist():
                x, near = np.frombuffer(r["vecs"], "<i4").reshape(-1, dim).astype(np.int64), np.frombuffer(r["near"], "<i4")
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(near), pa.array(((x - new[near]) ** 2).sum(1))],
                                                 names=["vec_id", "cluster", "distance"])

    final = state.select("ids", "vecs", "near").mapInArrow(measured, "vec_id long, cluster int, distance long")
    by_cluster = {r[0]: r[1] for r in final.groupBy("cluster").agg(F.sum("distance")).collect()}      # k rows
    shown = [(c, by_cluster[c], sum(by_cluster.values()), hashlib.sha256(",".join(map(str, new[c].tolist())).encode()).hexdigest())
             for c in sorted(by_cluster)]
    table = spark.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
