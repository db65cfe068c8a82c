"""Regularised histogram boosting for many models at once.

Features are binned once and packed into blocks of rows. A level of the trees of all models (grid points, folds,
targets) is one Spark aggregate: each task sums gradients and counts per (model, node, feature, bin) over its blocks,
the sums meet by (model, node), and the best splits come back, one row a node. Rows never leave their blocks; every
few rounds the blocks are written anew with the predictions so far, so a lost executor costs a few trees. A node of at
most SMALL / 10 rows is finished by one task, which gets its rows and grows the whole subtree below it, so a round takes as
many jobs as there are levels of larger nodes, plus one; a model of at most WHOLE x SMALL rows is that all the way, and one
task grows its trees one after the other. Boosting goes on from where it stopped: the validation error of
every round is kept, and a model ends when it has not fallen for ``patience`` rounds.

Where one task grows a model, features with few distinct joint values share one count of those, from which the counts of
each follow. Up to SMALL / 10 rows the gradients are added row by row (``Kept``); above, they are added up like the counts,
rows with equal bins are one row with a weight, as every tree treats them alike, and of two children only the one of fewer
rows is added up (``Gathered``).
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, forget, written

BINS = 64                  # most bins of a feature
BLOCK = 2048               # rows of a block
SAMPLE = 50_000            # rows from which the borders of bins are taken, chosen by hash
SMALL = 1_000_000          # a tenth: rows of a node whose subtree one task finishes, and of a model that keeps its order of sums
WHOLE = 6                  # times SMALL: rows of a model that one task grows
PIECE = 1 << 17            # rows that a model's task takes at a time
UPPER = 4                  # levels of a tree that predictions compare whole columns with
WALKED = 1 << 14           # rows that are predicted at a time
ALIKE = 1 << 17            # rows of which equal binned ones are predicted once
JOINT = 1024               # most distinct values of neighbouring features that are counted together
EVERY = 10                 # rounds between two written states
ROWS_PER_TASK = 1_000_000  # rows that a task holds at most, beyond what the cluster's cores take


@dataclass(frozen=True)
class Spec:
    """One model: squared loss on ``label`` over the rows where ``train`` holds, stopped by the rows of ``val``
    (names of boolean columns). Leaves are -G / (H + l2), shrunk by ``rate``."""
    label: str
    depth: int = 4
    rate: float = 0.05
    l2: float = 3.0
    train: str = "is_train"
    val: str = "is_val"
    rounds: int = 1000
    patience: int = 50


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2 i + 1 and 2 i + 2); rows with bin > ``cut`` go right; feature -1: all left."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    count: np.ndarray

    def leaf(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Place of every row in the last level (or after ``levels``), from 0."""
        node = np.zeros(len(bins), np.int64)
        depth = (len(self.feature) + 1).bit_length() - 1
        flat, start, f, cut = bins.ravel(), np.arange(len(bins)) * bins.shape[1], np.maximum(self.feature, 0), np.where(self.feature < 0, 255, self.cut)
        for _ in range(depth if levels is None else levels):
            node = 2 * node + 1 + (flat[start + f[node]] > cut[node])
        return node - ((1 << (depth if levels is None else levels)) - 1)

    def place(self, cols: np.ndarray) -> np.ndarray:
        """``leaf`` for bins with a row per feature. In the upper levels every node is compared with all rows, whole
        columns at a time, and the comparisons on a row's path are picked by its bits so far; below, rows are walked."""
        depth, bits = (len(self.feature) + 1).bit_length() - 1, []
        for level in range(min(depth, UPPER)):
            at = (1 << level) - 1
            c = [(cols[f] > t if f >= 0 else np.zeros(cols.shape[1], bool)).view(np.uint8)
                 for f, t in zip(self.feature[at:2 * at + 1].tolist(), self.cut[at:2 * at + 1].astype(np.uint8))]
            for b in reversed(bits):
                c = [left ^ ((left ^ right) & b) for left, right in zip(c[::2], c[1::2])]
            bits.append(c[0])
        node = np.zeros(cols.shape[1], np.uint8)
        for b in bits:
            node = 2 * node + b
        node = node.astype(np.int64)
        if depth > UPPER:
            node += (1 << UPPER) - 1
            flat, row, cut = cols.ravel(), np.arange(cols.shape[1]), np.where(self.feature < 0, 255, self.cut)
            start = np.maximum(self.feature, 0).astype(np.int64) * cols.shape[1]
            for _ in range(UPPER, depth):
                node = 2 * node + 1 + (flat[start[node] + row] > cut[node])
            node -= (1 << depth) - 1
        return node


class Packed(Sequence):
    """Trees of one depth, compressed; they are unpacked while they are walked, so a driver or a broadcast holds few bytes."""

    def __init__(self, depth: int, number: int, data: bytes):
        self.depth, self.number, self.data = depth, number, data

    @classmethod
    def of(cls, trees: Sequence[Tree]) -> Packed:
        columns = [np.stack([getattr(t, name) for t in trees]).astype(kind) for name, kind, _ in cls.columns(0)]
        return cls((len(trees[0].feature) + 1).bit_length() - 1, len(trees), zlib.compress(b"".join(c.tobytes() for c in columns), 1))

    @staticmethod
    def columns(depth: int) -> list[tuple[str, str, int]]:
        inner, leaves = (1 << depth) - 1, 1 << depth
        return [("feature", "<i4", inner), ("cut", "u1", inner), ("value", "<f8", leaves), ("count", "<f8", leaves)]

    def __len__(self) -> int:
        return self.number

    def __iter__(self) -> Iterator[Tree]:
        raw, at, columns = zlib.decompress(self.data), 0, []
        for _, kind, n in self.columns(self.depth):
            columns.append(np.frombuffer(raw, kind, self.number * n, at).reshape(self.number, n))
            at += columns[-1].nbytes
        return (Tree(*row) for row in zip(*columns))

    def __getitem__(self, i):
        return list(self)[i]


@dataclass
class Model:
    spec: Spec
    features: list[str]
    borders: list[list[float]]
    base: float = 0.0
    trees: Sequence[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)      # mean squared validation error after 0, 1, ... trees
    importance: list[float] = field(default_factory=list)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out, trees = np.full(len(bins), self.base), list(self.trees)
        for a in range(0, len(bins), WALKED):
            cols, mine = np.ascontiguousarray(bins[a:a + WALKED].T), out[a:a + WALKED]
            for t in trees:
                mine += (self.spec.rate * t.value).take(t.place(cols))
        return out

    def end(self) -> None:
        """Keeps the trees up to the least validation error."""
        if self.errors and any(self.errors):
            self.trees = self.trees[:int(np.argmin(self.errors))]
        self.importance = importance(self)
        if self.trees:
            self.trees = Packed.of(self.trees)

    def to_json(self) -> str:
        t = self.trees if isinstance(self.trees, Packed) or not self.trees else Packed.of(self.trees)
        return json.dumps({**asdict(replace(self, trees=[])), "trees": [len(t), base64.b64encode(t.data).decode()] if t else []})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        spec, t = Spec(**d["spec"]), d["trees"]
        trees = Packed(spec.depth, t[0], base64.b64decode(t[1])) if t else []
        return cls(spec, d["features"], d["borders"], d["base"], trees, d["errors"], d["importance"])


def joined(bins: np.ndarray, width: np.ndarray) -> list[tuple[np.ndarray, list[int], np.ndarray]]:
    """Groups of features that are counted together: codes of the rows, features, their bins by code."""
    groups = []
    for f, w in enumerate(width):
        b = bins[:, f].astype(np.uint16)
        for i, (code, features, table) in enumerate(groups):
            if len(table) * w <= JOINT * BINS:
                joint = code.astype(np.int64) * w + b
                seen = np.flatnonzero(np.bincount(joint, minlength=len(table) * w))
                if len(seen) <= JOINT:
                    place = np.zeros(len(table) * w, np.uint16)
                    place[seen] = np.arange(len(seen))
                    groups[i] = place[joint], [*features, f], np.column_stack([table[seen // w], seen % w])
                    break
        else:
            groups.append((b, [f], np.arange(w)[:, None]))
    return groups


def cells_of(features: list[int], table: np.ndarray, width: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which cells a group's codes add to (a 0/1 matrix), and the places of these cells among all."""
    cells = np.concatenate([offset[f] + np.arange(width[f]) for f in features])
    to, start = np.zeros((len(table), len(cells))), np.cumsum([0, *[width[f] for f in features]])
    for j in range(len(features)):
        to[np.arange(len(table)), start[j] + table[:, j]] = 1.0
    return to, cells


class Kept:
    """Rows of models with the same label and parts, as they came. Gradients are added in the order of the rows, one
    feature after the other; counts, exact in any order, by groups of features."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, part: np.ndarray, width: np.ndarray, offset: np.ndarray):
        self.bins, self.part, self.y, self.val = np.asfortranarray(bins), part, y, part >= 2
        self.train, self.held_out = np.flatnonzero(part & 1), bool(self.val.any())
        self.columns = [(bins[self.train, f].astype(np.int64), w, slice(at, at + w)) for f, (w, at) in enumerate(zip(width, offset))]
        self.groups = [(code, len(table), *cells_of(fs, table, width, offset)) for code, fs, table in joined(bins[self.train], width)]

    def error(self, p: np.ndarray) -> float:
        return float(((p - self.y)[self.val] ** 2).mean()) if self.held_out else 0.0

    def gradients(self, p: np.ndarray) -> np.ndarray:
        return (p - self.y)[self.train]

    def sums(self, node: np.ndarray, nodes: int, g: np.ndarray, cells: int) -> np.ndarray:
        """Gradient sums and row counts of the train rows by node and cell."""
        out = np.zeros((2, nodes, cells))
        for b, w, at in self.columns:
            out[0][:, at] = np.bincount(node * w + b, g, nodes * w).reshape(nodes, w)
        for code, n, to, cols in self.groups:
            out[1][:, cols] = np.bincount(node * n + code, minlength=nodes * n).reshape(nodes, n) @ to
        return out

    def root(self, depth: int, g: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """Every row's place in the first level, and the sums of that level."""
        node = np.zeros(len(self.y), np.int64)
        return node, self.sums(node[self.train], 1, g, cells)

    def below(self, node: np.ndarray, f: np.ndarray, cut: np.ndarray, less: np.ndarray, g: np.ndarray, sums: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places in the next level after the splits ``f``, ``cut`` of the nodes, and its sums unless it is the ``last``."""
        size = len(self.y)
        start, cut = np.maximum(f, 0) * size, np.where(f < 0, 255, cut)
        node = 2 * node + (self.bins.ravel("F")[start[node] + np.arange(size)] > cut[node])
        return node, sums if last else self.sums(node[self.train], 2 * len(f), g, sums.shape[2])


class Gathered:
    """Rows of models with the same label and parts, as these need them: distinct rows with their weights and mean
    labels, train rows first, those in both parts next, and groups of features that are counted together. Of two
    children only the one of fewer rows is added up, and the other is what is left of their parent. Rows are walked in
    pieces that a core's cache holds."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, part: np.ndarray, width: np.ndarray, offset: np.ndarray):
        groups = joined(bins, width)
        key, top = np.array([0, 0, 2, 1])[part], 3        # in the order of parts
        for code, _, table in groups:
            if top * len(table) >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
                top = int(key.max(initial=0)) + 1
            key, top = key * len(table) + code, top * len(table)
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        del key
        self.bins, self.part = np.empty((len(first), len(width)), np.uint8, "F"), part[first]
        for f in range(len(width)):
            self.bins[:, f] = bins[first, f]
        self.weight = np.bincount(at, minlength=len(first)).astype(np.float64)
        self.mean = np.bincount(at, y, len(first)) / self.weight
        off = y[part >= 2] - self.mean[at[part >= 2]]
        self.spread = float((off * off).sum())                     # of the validation rows around the means
        self.train, self.val = slice(0, int((self.part & 1).sum())), slice(int((self.part == 1).sum()), None)
        self.held_out, self.counts = self.weight[self.val].sum(), None
        self.groups = [(code[first][self.train], len(table), *cells_of(fs, table, width, offset)) for code, fs, table in groups]

    def error(self, p: np.ndarray) -> float:
        v = self.val
        return float(self.spread + (self.weight[v] * (p[v] - self.mean[v]) ** 2).sum()) / self.held_out if self.held_out else 0.0

    def gradients(self, p: np.ndarray) -> np.ndarray:
        t = self.train
        return self.weight[t] * (p[t] - self.mean[t])

    def sums(self, node: np.ndarray, nodes: int, g: np.ndarray, cells: int) -> np.ndarray:
        """Gradient sums and row counts of the train rows by node and cell."""
        out = np.zeros((2, nodes, cells))
        for code, n, to, cols in self.groups:
            where = node * n + code
            for x, weight in zip(out, (g, self.weight[self.train])):
                x[:, cols] = np.bincount(where, weight, nodes * n).reshape(nodes, n) @ to
        return out

    def root(self, depth: int, g: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """Every row's place in the first level, and the sums of that level."""
        if self.counts is None:
            self.counts = self.sums(np.zeros(len(g), np.int64), 1, g, cells)[1]          # the same for every tree
        out = np.stack([np.zeros((1, cells)), self.counts])
        for code, n, to, cols in self.groups:
            out[0][:, cols] = np.bincount(code, g, n)[None] @ to
        return np.zeros(len(self.bins), np.min_scalar_type((1 << depth) - 1)), out

    def below(self, node: np.ndarray, f: np.ndarray, cut: np.ndarray, less: np.ndarray, g: np.ndarray, sums: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places in the next level after the splits ``f``, ``cut`` of the nodes (changed in place), and its sums unless
        it is the ``last``. ``less``: of each node's two children the one to be added up."""
        size, nodes, weight = len(self.bins), len(f), self.weight[self.train]
        flat, start, cut = self.bins.ravel("F"), np.maximum(f, 0) * size, np.where(f < 0, 255, cut).astype(np.uint8)
        added = np.zeros(2 * nodes, bool)
        added[less] = True
        found = [np.zeros((2, nodes * n)) for _, n, _, _ in self.groups]
        piece = max(PIECE, 8 * nodes * max((n for _, n, _, _ in self.groups), default=1))
        for a in range(0, size, piece):
            k = node[a:a + piece].astype(np.int64)
            at = start[k]
            at += np.arange(a, a + len(k))
            right = flat[at] > cut[k]
            k += k
            k += right
            node[a:a + piece] = k
            if last or a >= len(g):
                continue
            mine = np.flatnonzero(added[k[:len(g) - a]])
            parent, some, much = k[mine] >> 1, g[a:a + piece][mine], weight[a:a + piece][mine]
            for (code, n, _, _), x in zip(self.groups, found):
                where = parent * n
                where += code[a:a + piece][mine]
                x[0] += np.bincount(where, some, nodes * n)
                x[1] += np.bincount(where, much, nodes * n)
        if last:
            return node, sums
        out = np.empty((2, 2 * nodes, sums.shape[2]))
        for i in range(2):
            small = np.zeros((nodes, sums.shape[2]))
            for (_, n, to, cols), x in zip(self.groups, found):
                small[:, cols] = x[i].reshape(nodes, n) @ to
            out[i][less], out[i][less ^ 1] = small, sums[i] - small
        return node, out


def bin_borders(df: DataFrame, features: list[str], row_key: str, bins: int = BINS) -> list[list[float]]:
    """At most ``bins - 1`` borders of every feature: between neighbouring values if there are few, else at quantiles.
    They are taken from about SAMPLE rows of smallest hash of ``row_key`` (any borders give a valid model)."""
    total = df.count()
    share = F.pmod(F.xxhash64(row_key), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    some = df.filter(share).select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]).toArrow()
    out = []
    for c in features:
        x = np.unique(some.column(c).to_numpy())
        if len(x) > bins:
            x = np.unique(np.quantile(some.column(c).to_numpy(), np.linspace(0, 1, bins), method="lower"))
        out.append(((x[1:] + x[:-1]) / 2).tolist())
    return out


def bin_rows(b: pa.RecordBatch, at: int, borders: list[list[float]]) -> np.ndarray:
    """Bins of the feature columns from ``at`` on: the number of borders below the value."""
    cols = [np.searchsorted(np.array(r), b.column(at + i).to_numpy(zero_copy_only=False), "left") for i, r in enumerate(borders)]
    return np.stack(cols, 1).astype(np.uint8) if cols else np.zeros((b.num_rows, 0), np.uint8)


def fit_many(df: DataFrame, features: list[str], specs: list[Spec], row_key: str = "id", bins: int = BINS,
             borders: list[list[float]] | None = None) -> list[Model]:
    """The models of ``specs``, all grown together. Null features count as 0; rows with a null label take no part in
    the models of that label; a model without train rows predicts 0, one without validation rows runs all its rounds."""
    spark = df.sparkSession
    borders = borders or bin_borders(df, features, row_key, bins)
    labels, masks = sorted({s.label for s in specs}), sorted({m for s in specs for m in (s.train, s.val)})
    at = {name: i for i, name in enumerate(labels)}, {name: i for i, name in enumerate(masks)}
    src = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)],
                    *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(labels)],
                    *[F.coalesce(F.col(c), F.lit(False)).alias(f"m{i}") for i, c in enumerate(masks)], F.xxhash64(row_key).alias("h"))
    n = df.count()
    parts = max(1, min(-(-n // 4096), max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))))
    nf, ny, nm = len(features), len(labels), len(masks)
    width = np.array([len(b) + 1 for b in borders])
    offset, cells = np.concatenate([[0], np.cumsum(width)[:-1]]).astype(np.int64), int(width.sum())
    models = [Model(s, features, borders) for s in specs]

    def pack(batches):
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                p = b.slice(i, BLOCK)
                y = np.stack([p.column(nf + j).to_numpy(zero_copy_only=False) for j in range(ny)], 1).astype(np.float64)
                m = np.stack([p.column(nf + ny + j).to_numpy(zero_copy_only=False) for j in range(nm)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bin_rows(p, 0, borders), y, m, np.zeros((0, 0)))],
                                                 names=["bins", "y", "masks", "pred"])

    ddl = "bins binary, y binary, masks binary, pred binary"
    dealt = src.repartition(parts, "h").sortWithinPartitions("h", *[f"y{i}" for i in range(ny)])
    state = written(dealt.mapInArrow(pack, ddl), "blocks")

    def block(r):
        y = np.frombuffer(r["y"], np.float64).reshape(-1, ny)
        pred = np.frombuffer(r["pred"], np.float64).reshape(len(y), -1) if r["pred"] else None
        return np.frombuffer(r["bins"], np.uint8).reshape(len(y), nf), y, np.frombuffer(r["masks"], np.uint8).reshape(-1, nm).astype(bool), pred

    def label_sums(batches):
        s = np.zeros((len(specs), 3))
        for b in batches:
            for r in b.to_pylist():
                _, y, m, _ = block(r)
                for i, sp in enumerate(specs):
                    v = y[m[:, at[1][sp.train]], at[0][sp.label]]
                    s[i] += np.nansum(v), (~np.isnan(v)).sum(), m[:, at[1][sp.val]].sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(specs)), pa.int32()), *[pa.array(s[:, j]) for j in range(3)]], names=["model", "s", "n", "v"])

    train_rows, all_rows = [0.0] * len(specs), [0.0] * len(specs)
    for r in state.mapInArrow(label_sums, "model int, s double, n double, v double").groupBy("model").agg(
            F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        models[r.model].base = r.s / r.n if r.n else 0.0
        train_rows[r.model], all_rows[r.model] = r.n, r.n + r.v
    base = np.array([m.base for m in models])

    def now(bins, pred, i, since):
        p = np.full(len(bins), base[i]) if pred is None else pred[:, i].copy()
        for t in since[i]:
            p += specs[i].rate * t.value[t.leaf(bins)]
        return p

    def sums(since, grown, level, todo):
        """Gradient sums and counts of the large nodes of a level, the rows of the small ones, and at level 0 the
        validation errors (node -1). ``todo``: for each model its large and its small nodes."""
        def run(batches):
            from pyspark import TaskContext
            task, hist, loss, held = TaskContext.get().partitionId(), {}, {}, {}
            for b in batches:
                for r in b.to_pylist():
                    bins, y, m, pred = block(r)
                    cell = bins.astype(np.int64) + offset
                    for i, (large, small) in todo.items():
                        s, p = specs[i], now(bins, pred, i, since)
                        g = p - y[:, at[0][s.label]]
                        fine = ~np.isnan(g)
                        if level == 0:
                            v = g[m[:, at[1][s.val]] & fine]
                            e = loss.setdefault(i, np.zeros(2))
                            e += float((v * v).sum()), len(v)
                        rows = np.flatnonzero(m[:, at[1][s.train]] & fine)
                        node = grown[i].leaf(bins[rows], level)
                        if large:
                            big = np.isin(node, large)
                            where = (node[big, None] * cells + cell[rows[big]]).ravel()
                            size = (1 << level) * cells
                            h = hist.setdefault(i, np.zeros((2, size)))
                            h[0] += np.bincount(where, np.repeat(g[rows[big]], nf), size)
                            h[1] += np.bincount(where, minlength=size)
                        for k in small:
                            mine = rows[node == k]
                            if len(mine):
                                held.setdefault((i, k), []).append((bins[mine], g[mine]))
            out = [(i, -1, e, e) for i, e in loss.items()]
            for i, h in hist.items():
                g, c = h.reshape(2, -1, cells)
                out += [(i, k, g[k], c[k]) for k in np.flatnonzero(c.any(1))]
            out += [(i, k, np.concatenate([x[1] for x in v]), np.concatenate([x[0] for x in v])) for (i, k), v in held.items()]
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in out], pa.int32()), pa.array([int(x[1]) for x in out], pa.int32()), pa.array([task] * len(out), pa.int32()),
                    pa.array([x[2].tobytes() for x in out], pa.binary()), pa.array([x[3].tobytes() for x in out], pa.binary())],
                    names=["model", "node", "task", "g", "c"])
        return run

    last = np.concatenate([offset[1:], [cells]]) - 1                       # the last cell of each feature: no cut
    of_cell = np.repeat(np.arange(nf), width)

    def best_splits(g, c, l2):
        """For nodes as rows of sums and counts per cell: feature (-1: none), cut, sums left and in all."""
        total_g, total_c = g[:, :width[0]].sum(1), c[:, :width[0]].sum(1)
        gl, cl = np.cumsum(g, 1), np.cumsum(c, 1)
        if nf > 1:                                                         # sums within each feature
            for x in (gl, cl):
                x[:, offset[1]:] -= x[:, offset[1:] - 1][:, of_cell[offset[1]:] - 1]
        gr, cr = total_g[:, None] - gl, total_c[:, None] - cl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl * gl / (cl + l2) + gr * gr / (cr + l2) - (total_g * total_g / (total_c + l2))[:, None]
        gain[(cl < 0.5) | (cr < 0.5)] = -1.0
        gain[:, last] = -1.0
        j = gain.argmax(1)
        row = np.arange(len(g))
        some = gain[row, j] > 1e-12 * (1 + np.abs(total_g))
        f = np.where(some, of_cell[j], -1)
        return f, np.where(some, j - offset[f], 0), gl[row, j], np.rint(cl[row, j]), total_g, total_c

    def subtree(bins, g, depth, l2):
        """The tree of one node's rows, in heap order."""
        t = Tree(np.full((1 << depth) - 1, -1, np.int64), np.zeros((1 << depth) - 1, np.int64), np.zeros(1 << depth), np.zeros(1 << depth))
        cell = bins.astype(np.int64) + offset
        for level in range(depth):
            node = t.leaf(bins, level)
            where, size = (node[:, None] * cells + cell).ravel(), (1 << level) * cells
            hg = np.bincount(where, np.repeat(g, nf), size).reshape(-1, cells)
            hc = np.bincount(where, minlength=size).reshape(-1, cells).astype(np.float64)
            f, cut, gl, cl, tg, tc = best_splits(hg, hc, l2)
            for k in np.flatnonzero(tc > 0):
                add(t, depth, l2, level, k, int(f[k]), int(cut[k]), tg[k], tc[k], gl[k], cl[k])
        return t

    def splits(level, kinds):
        """The best split of every large node from the sums of all tasks, which come one after the other, and the whole
        subtree of every small one from its rows."""
        def run(batches):
            key, held = None, []                                       # rows of a small node by task, or the sums so far

            def best():
                i, k = key
                if k < 0:
                    return i, k, -1, -1, held[0][0], held[0][1], 0.0, 0.0, None                  # summed loss, rows
                if k in kinds[i][1]:
                    bins = np.concatenate([c.view(np.uint8).reshape(-1, nf) for _, c in held])
                    t = subtree(bins, np.concatenate([g for g, _ in held]), specs[i].depth - level, specs[i].l2)
                    return i, k, -1, -1, 0.0, 0.0, 0.0, 0.0, np.concatenate([t.feature, t.cut, t.value, t.count]).astype("<f8").tobytes()
                f, cut, gl, cl, tg, tc = best_splits(held[0][None], held[1][None], specs[i].l2)
                return i, k, int(f[0]), int(cut[0]), tg[0], tc[0], gl[0], cl[0], None

            done = []
            for b in batches:
                for m, k, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    if (m, k) != key:
                        if key is not None:
                            done.append(best())
                        key, held = (m, k), []
                    if k >= 0 and k in kinds[m][1]:
                        held.append((np.frombuffer(x), np.frombuffer(y, np.uint8)))
                    elif held:
                        held = [held[0] + np.frombuffer(x), held[1] + np.frombuffer(y)]
                    else:
                        held = [np.frombuffer(x), np.frombuffer(y)]
            if key is not None:
                done.append(best())
            if done:
                types = [pa.int32()] * 4 + [pa.float64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)],
                                                 names=["model", "node", "feature", "cut", "g", "c", "gl", "cl", "sub"])
        return run

    def checkpointed(since):
        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    bins, y, _, pred = block(r)
                    p = np.stack([now(bins, pred, i, since) for i in range(len(specs))], 1)
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (r["bins"], r["y"], r["masks"], p.tobytes())],
                                                     names=["bins", "y", "masks", "pred"])
        return run

    def rows_of(shares):
        """The train and validation rows of the models of each share, which have the same label and parts."""
        def run(batches):
            from pyspark import TaskContext
            place = TaskContext.get().partitionId() << 32
            for b in batches:
                for r in b.to_pylist():
                    bins, y, m, _ = block(r)
                    place += 1
                    for j, (i, *_) in enumerate(shares):
                        v, t, e = y[:, at[0][specs[i].label]], m[:, at[1][specs[i].train]], m[:, at[1][specs[i].val]]
                        mine = (t | e) & ~np.isnan(v)
                        row = (j, place, bins[mine].tobytes(), v[mine].tobytes(), (t[mine] + 2 * e[mine]).astype(np.uint8).tobytes())
                        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=["share", "place", "bins", "y", "part"])
        return run

    def boost(m, rows):
        """All rounds of a model."""
        s, depth, p, some = m.spec, m.spec.depth, m.raw(rows.bins), len(rows.part[rows.train])
        while len(p):
            m.errors.append(rows.error(p))
            if over(m) or not some:
                break
            t = Tree(np.full((1 << depth) - 1, -1, np.int64), np.zeros((1 << depth) - 1, np.int64), np.zeros(1 << depth), np.zeros(1 << depth))
            g = rows.gradients(p)
            node, found = rows.root(depth, g, cells)                         # place in the level
            for level in range(depth):
                f, cut, gl, cl, tg, tc = best_splits(*found, s.l2)
                for k in np.flatnonzero(tc > 0):
                    add(t, depth, s.l2, level, k, int(f[k]), int(cut[k]), tg[k], tc[k], gl[k], cl[k])
                less = 2 * np.arange(len(f)) + np.where(f < 0, True, cl > tc - cl)
                node, found = rows.below(node, f, cut, less, g, found, level + 1 == depth)
            m.trees.append(t)
            for a in range(0, len(p), PIECE):
                p[a:a + PIECE] += (s.rate * t.value).take(node[a:a + PIECE])

    def boost_here(batches):
        """Whole models from their rows, which come one share after the other."""
        def grow(j, held):
            bins = np.concatenate([np.frombuffer(x[0], np.uint8).reshape(-1, nf) for x in held])
            y, part = np.concatenate([np.frombuffer(x[1]) for x in held]), np.concatenate([np.frombuffer(x[2], np.uint8) for x in held])
            held.clear()
            rows = (Kept if len(y) <= SMALL // 10 else Gathered)(bins, y, part, width, offset)
            del bins, y, part
            for i in shares[j]:
                m = Model(specs[i], features, borders, float(base[i]))
                boost(m, rows)
                m.end()
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([m.to_json()])], names=["model", "json"])

        key, held = None, []
        for b in batches:
            for j, *rest in zip(b.column(0).to_pylist(), *[b.column(c).to_pylist() for c in (2, 3, 4)]):
                if j != key:
                    if held:
                        yield from grow(key, held)
                    key, held = j, []
                held.append(rest)
        if held:
            yield from grow(key, held)

    small, ended = [i for i in range(len(specs)) if all_rows[i] <= SMALL * WHOLE], set()
    if small:
        shares = shared_out([specs[i] for i in small], spark.sparkContext.defaultParallelism)
        shares = [[small[i] for i in x] for x in shares]
        mine = state.mapInArrow(rows_of(shares), "share int, place long, bins binary, y binary, part binary")
        mine = mine.repartitionById(len(shares), F.col("share")).sortWithinPartitions("share", "place")
        for r in mine.mapInArrow(boost_here, "model int, json string").collect():
            models[r.model] = Model.from_json(r.json)
            ended.add(r.model)
    since = [[] for _ in specs]
    active, held = [i for i in range(len(specs)) if i not in small], 0
    while active:
        grown = {i: Tree(np.full((1 << specs[i].depth) - 1, -1, np.int64), np.zeros((1 << specs[i].depth) - 1, np.int64), np.zeros(1 << specs[i].depth),
                         np.zeros(1 << specs[i].depth)) for i in active}
        counts, level = {i: {0: train_rows[i]} for i in active}, 0            # rows of the nodes that are still open
        while counts:
            todo = {i: ([k for k, c in n.items() if c > SMALL // 10], [k for k, c in n.items() if c <= SMALL // 10]) for i, n in counts.items()}
            got = state.mapInArrow(sums(since, grown, level, todo), "model int, node int, task int, g binary, c binary")
            keys = sum(len(a) + len(b) for a, b in todo.values())
            weight = sum(len(a) * cells + sum(counts[i][k] for k in b) * nf for i, (a, b) in todo.items())
            reduce = max(1, min(parts, keys, int(weight // 200_000)))
            got = got.repartition(reduce, "model", "node").sortWithinPartitions("model", "node", "task")
            rows = got.mapInArrow(splits(level, todo), "model int, node int, feature int, cut int, g double, c double, gl double, cl double, sub binary").collect()
            if level == 0:                                             # the error after the trees so far decides who goes on
                heard = set()
                for r in rows:
                    if r.node < 0:
                        models[r.model].errors.append(r.g / r.c if r.c else 0.0)
                        heard.add(r.model)
                active = [i for i in active if i in heard and not over(models[i])]
            counts = {}
            for r in rows:
                if r.node < 0 or r.model not in active:
                    continue
                s, t = specs[r.model], grown[r.model]
                if r.sub is not None:
                    graft(t, s.depth, level, r.node, np.frombuffer(bytes(r.sub)))
                    continue
                add(t, s.depth, s.l2, level, r.node, r.feature, r.cut, r.g, r.c, r.gl, r.cl)
                if r.feature >= 0 and level + 1 < s.depth:
                    counts.setdefault(r.model, {}).update({2 * r.node: r.cl, 2 * r.node + 1: r.c - r.cl})
            level += 1
        for i in active:
            models[i].trees.append(grown[i])
            since[i].append(grown[i])
        held += 1
        if held == EVERY and active:
            before, state = state, written(state.mapInArrow(checkpointed(since), ddl), "blocks")
            forget(before)
            since, held = [[] for _ in specs], 0
    for i, m in enumerate(models):
        if i not in ended:
            m.end()
    return models


def shared_out(specs: list[Spec], cores: int) -> list[list[int]]:
    """Models (by their numbers) dealt into shares, each grown by one task from the same rows: as many shares as there
    are cores, if there are as many models; the deepest trees first."""
    alike: dict[tuple, list[int]] = {}
    for i, s in enumerate(specs):
        alike.setdefault((s.label, s.train, s.val), []).append(i)
    out = []
    for some in alike.values():
        n = max(1, min(len(some), cores // len(alike)))
        some = sorted(some, key=lambda i: (-specs[i].depth, specs[i].rate, i))
        out += [[i for j, i in enumerate(some) if (j % n if j // n % 2 == 0 else n - 1 - j % n) == k] for k in range(n)]
    return out


def over(m: Model) -> bool:
    """Whether a model has all its rounds, or its validation error has not fallen for ``patience`` of them."""
    rounds = len(m.errors) - 1
    stale = any(m.errors) and rounds - int(np.argmin(m.errors)) >= m.spec.patience
    return rounds >= m.spec.rounds or stale


def add(tree: Tree, depth: int, l2: float, level: int, node: int, feature: int, cut: int, g: float, c: float, gl: float, cl: float) -> None:
    """Takes the best split of a node into a tree; what has no children yet becomes a leaf."""
    at, below = (1 << level) - 1 + node, depth - level - 1
    tree.feature[at], tree.cut[at] = feature, cut
    sides = [(node * 2, gl, cl), (node * 2 + 1, g - gl, c - cl)] if feature >= 0 else [(node * 2, g, c)]
    for k, sg, sc in sides:
        tree.value[k << below], tree.count[k << below] = -sg / (sc + l2), sc


def graft(tree: Tree, depth: int, level: int, node: int, flat: np.ndarray) -> None:
    """Puts a subtree (features, cuts, values and counts in one row) under a node."""
    below = depth - level
    inner, leaves = (1 << below) - 1, 1 << below
    f, cut, value, count = np.split(flat, [inner, 2 * inner, 2 * inner + leaves])
    for s in range(below):
        to, at = (1 << (level + s)) - 1 + (node << s), (1 << s) - 1
        tree.feature[to:to + (1 << s)], tree.cut[to:to + (1 << s)] = f[at:at + (1 << s)], cut[at:at + (1 << s)]
    tree.value[node << below:(node + 1) << below], tree.count[node << below:(node + 1) << below] = value, count


def importance(m: Model) -> list[float]:
    """How much predictions change, on average over the train rows, if a split goes the other way: for every split
    the squared distances of its two sides' mean values from their common mean, weighted by their rows; in per cent.
    Row counts are those of the histograms that the tree was grown from."""
    out = np.zeros(len(m.features))
    for t in m.trees:
        value, count = t.value * m.spec.rate, t.count
        depth = (len(t.feature) + 1).bit_length() - 1
        for level in range(depth - 1, -1, -1):
            v, c = value.reshape(-1, 2), count.reshape(-1, 2)
            n = c.sum(1)
            mean = (v * c).sum(1) / np.maximum(n, 1)
            change = (c * (v - mean[:, None]) ** 2).sum(1)
            f = t.feature[(1 << level) - 1:(1 << (level + 1)) - 1]
            np.add.at(out, f[f >= 0], change[f >= 0])
            value, count = mean, n
    return (100 * out / out.sum()).tolist() if out.sum() > 0 else out.tolist()


def predict(df: DataFrame, models: dict[str, Model], keep: Sequence[str] | None = None, of: str | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the raw output of every model, under its name. With ``of``, a column of model
    names, a row gets the output of its own model alone, and null for the others."""
    first = next(iter(models.values()))
    keep = [c for c in (df.columns if keep is None else keep) if c not in models]
    src = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__f{i}") for i, c in enumerate(first.features)])
    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType(df.select(*keep).schema.fields + [StructField(n, DoubleType()) for n in models])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow, shared = to_arrow_schema(schema), df.sparkSession.sparkContext.broadcast(models)

    def outputs(b):
        bins = bin_rows(b, len(keep), first.borders)
        own = None if of is None else np.array(b.column(keep.index(of)).to_pylist(), object)
        kind = np.ascontiguousarray(bins).view(f"V{max(1, bins.shape[1])}").ravel() if bins.size else np.zeros(len(bins), np.uint8)
        _, one, at = np.unique(kind, return_index=True, return_inverse=True)
        for name, m in shared.value.items():
            if own is None:
                yield pa.array(m.raw(bins[one])[at])
            else:
                mine = own == name
                used, back = np.unique(at[mine], return_inverse=True)
                out = np.zeros(len(bins))
                out[mine] = m.raw(bins[one[used]])[back]
                yield pa.array(out, mask=~mine)

    def answered(held):
        b = pa.Table.from_batches(held).combine_chunks()
        cols = [b.column(i).combine_chunks() for i in range(len(keep))] + list(outputs(b))
        yield from pa.Table.from_arrays([c.cast(t) for c, t in zip(cols, arrow.types)], schema=arrow).to_batches(max_chunksize=10_000)

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ALIKE:
                yield from answered(held)
                held, n = [], 0
        if n:
            yield from answered(held)
    return src.mapInArrow(run, schema)


def fitted(df: DataFrame, features: list[str], specs: list[Spec], row_key: str = "id") -> list[Model]:
    """``fit_many``, kept in the shared folder under a digest of the rows, the features and the specs: a query that
    needs the very same models reads them. Other rows or parameters have another digest, so no model is ever stale."""
    spark = df.sparkSession
    used = [row_key, *features, *sorted({x for s in specs for x in (s.label, s.train, s.val)})]
    h = F.xxhash64(*used)
    mark = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum(F.pmod(F.xxhash64(h), F.lit(1 << 40)).cast("decimal(38,0)"))).first()
    name = hashlib.sha256(repr((list(mark), used, [asdict(s) for s in specs], BINS, "packed")).encode()).hexdigest()
    folder = f"{checkpoint_dir(spark).rstrip('/')}/models-{name}"
    if _exists(spark, folder + "/_SUCCESS"):
        rows = spark.read.schema("i int, model string").parquet(folder).orderBy("i").collect()
        return [Model.from_json(r.model) for r in rows]
    models = fit_many(df, features, specs, row_key)
    spark.createDataFrame([(i, m.to_json()) for i, m in enumerate(models)], "i int, model string").write.mode("overwrite").parquet(folder)
    return models


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
