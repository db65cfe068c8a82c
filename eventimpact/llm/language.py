"""Language ID by partial matching: per-language byte context trees give every text an exact code length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, slices, utf8

PAD = 10  # a text is read as if line ends stood before it


def windows(data: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """Code of the last ``depth`` bytes at every byte of every text (line ends before the first)."""
    n = len(off) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * (depth - 1), np.diff(off))
    wide = np.full(len(data) + n * (depth - 1), PAD, np.uint64)
    wide[at] = data
    code = np.zeros(len(at), np.uint64)
    for k in range(depth):
        code |= wide[at - k] << np.uint64(8 * k)
    return code


@dataclass
class Children:
    """The node that a node and a symbol lead to, of one level. Sparse: an open-addressed table of at least twice as
    many slots as paths, so it grows with the paths seen, not with contexts times symbols."""
    width: int
    none: int                   # the node of paths never seen
    keys: np.ndarray            # node * width + symbol + 1, 0 in empty slots
    nodes: np.ndarray

    @classmethod
    def of(cls, width: int, up: np.ndarray, symbol: np.ndarray) -> Children:
        """Child i hangs below node ``up[i]`` by ``symbol[i]``."""
        key = up.astype(np.uint64) * np.uint64(width) + symbol.astype(np.uint64) + np.uint64(1)
        size = 1 << max(4, int(2 * len(key)).bit_length())
        keys, nodes = np.zeros(size, np.uint64), np.full(size, len(key), np.int32)
        slot, todo = cls.slots(key, size), np.arange(len(key))
        while len(todo):
            free = keys[slot[todo]] == 0
            keys[slot[todo[free]]] = key[todo[free]]           # of several for one slot the last stays
            won = keys[slot[todo]] == key[todo]
            nodes[slot[todo[won]]] = todo[won]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (size - 1)
        return cls(width, len(key), keys, nodes)

    @staticmethod
    def slots(key: np.ndarray, size: int) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def find(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = node.astype(np.uint64) * np.uint64(self.width) + symbol.astype(np.uint64) + np.uint64(1)
        slot = self.slots(key, len(self.keys))
        held = self.keys[slot]
        out = np.where(held == key, self.nodes[slot], np.int32(self.none))
        todo = np.flatnonzero((held != key) & (held != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.nodes[slot[todo[hit]]]
            todo = todo[~hit & (held != 0)]
        return out


@dataclass
class Model:
    """Frozen statistics. Level j holds the paths of j bytes seen in any language, as a tree: ``child[j]`` finds the
    node of a node of j-1 bytes and a symbol. ``bits[j][node, language]`` is the full code length of the path's last byte after the
    others, escapes included; ``escape[j][node of j-1 bytes, language]`` what leaving that context costs."""
    langs: list[str]
    symbol: np.ndarray
    child: list[Children]
    bits: list[np.ndarray]
    escape: list[np.ndarray]

    def code_lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of every text under every language."""
        depth, n = len(self.child), len(off) - 1
        at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * depth, np.diff(off))
        wide = np.full(len(data) + n * depth, self.symbol[PAD], np.int32)
        wide[at] = self.symbol[data]
        nodes = [np.zeros(len(wide), np.int32)]
        for j in range(depth):
            node = np.empty(len(wide), np.int32)
            node[0] = len(self.bits[j]) - 1
            node[1:] = self.child[j].find(nodes[-1][:-1], wide[1:])
            nodes.append(node)
        total = np.zeros((n, len(self.langs)))
        cost = np.zeros((len(at), len(self.langs)), np.float32)
        left = np.arange(len(at))
        for j in range(depth - 1, -1, -1):
            node = nodes[j + 1][at[left]]
            known = node < len(self.bits[j]) - 1
            cost[left[known]] += self.bits[j][node[known]]
            left = left[~known]
            cost[left] += self.escape[j][nodes[j][at[left] - 1]]
        cost[left] += 8.0
        full = np.flatnonzero(np.diff(off))
        if len(full):
            total[full] = np.add.reduceat(cost, off[full], axis=0, dtype=np.float64)
        return total


def build(langs: list[str], lang: np.ndarray, path: np.ndarray, count: np.ndarray, order: int) -> Model:
    """The model from counts of ``order + 1`` byte paths per language (escape method C: a context seen n times
    with d different followers codes a follower seen c times as c / (n + d) and escapes with d / (n + d))."""
    depth, size = order + 1, len(langs)
    seen = np.zeros(256, bool)
    for k in range(depth):
        seen[(path >> np.uint64(8 * k)) & np.uint64(255)] = True
    seen[PAD] = True
    width = int(seen.sum()) + 1
    symbol = np.full(256, width - 1, np.int32)
    symbol[seen] = np.arange(width - 1)
    child, bits, escape = [], [], []
    below = None                                     # paths and bits of the level before
    parents = np.zeros(1, np.uint64)
    for j in range(1, depth + 1):
        mask = np.uint64((1 << (8 * j)) - 1)
        code = path & mask
        # contexts of the next level are nodes too, also those that only stand before a text's first byte
        paths = np.unique(np.concatenate([code, (path >> np.uint64(8)) & mask]) if j < depth else code)
        seen_in = np.zeros((len(paths), size))
        np.add.at(seen_in, (np.searchsorted(paths, code), lang), count)
        up = np.searchsorted(parents, paths >> np.uint64(8))
        n, d = np.zeros((len(parents) + 1, size)), np.zeros((len(parents) + 1, size))
        np.add.at(n, up, seen_in)
        np.add.at(d, up, seen_in > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            esc = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
            own = -np.log2(seen_in / (n + d)[up])
        if j == 1:
            shorter = np.full((len(paths), size), 8.0)
        else:
            shorter = below[1][np.searchsorted(below[0], paths & np.uint64((1 << (8 * (j - 1))) - 1))]
        full = np.where(seen_in > 0, own, esc[up] + shorter)
        child.append(Children.of(width, up, symbol[(paths & np.uint64(255)).astype(np.int64)]))
        bits.append(np.vstack([full, np.zeros((1, size))]).astype(np.float32))
        escape.append(esc.astype(np.float32))
        below, parents = (paths, full), paths
    return Model(langs, symbol, child, bits, escape)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = 3,
          docs_per_lang: int = 1500, id_col: str = "doc_id") -> Model:
    """Context trees from about ``docs_per_lang`` texts of each language, chosen by a hash of the id (the
    documented bound); counts are summed by Spark, and the driver gets distinct paths of the sample only.
    Rows with null language or text teach nothing; without any row the model knows no language.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return build([], np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), order)
    pick = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20))
    rate = F.lit(0)
    number = F.lit(None)
    for i, name in enumerate(langs):
        rate = F.when(F.col(lang_col) == name, int((1 << 20) * min(1.0, docs_per_lang / sizes[name]))).otherwise(rate)
        number = F.when(F.col(lang_col) == name, i).otherwise(number)
    some = known.filter(pick < rate).select(number.cast("int").alias("lang"), F.col(text_col).alias("text"))

    def count(parts):
        for b in parts:
            data, off = utf8(b.column(1))
            where = np.asarray(b.column(0))
            for i, j in slices(off, 1 << 20):
                code = windows(data[off[i]:off[j]], off[i:j + 1] - off[i], order + 1)
                of = np.repeat(where[i:j], np.diff(off[i:j + 1])).astype(np.int64)
                for g in np.unique(of):
                    path, n = np.unique(code[of == g], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(path), g, np.int32)), pa.array(path.astype(np.int64)),
                                                      pa.array(n.astype(np.int64))], names=["lang", "path", "n"])

    got = some.mapInArrow(count, "lang int, path long, n long").groupBy("lang", "path").agg(F.sum("n").alias("n")).toArrow()
    lang, path, n = (got.column(c).to_numpy() for c in ("lang", "path", "n"))
    return build(langs, lang.astype(np.int64), path.astype(np.uint64), n.astype(np.float64), order)


def detect(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred",
           score_out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds the language of the shortest code and its posterior probability (all languages equally likely before).

    ``und`` with score 0: null texts, texts without a letter, and any text under a model without languages.
    Ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = "__letters"
    src = docs.withColumn(inner, F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)))

    def make():
        m = shared.value

        def f(texts):
            data, off = utf8(texts)
            best, prob = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1)
            if m.langs:
                for i, j in slices(off, 1 << 19):
                    bits = m.code_lengths(data[off[i]:off[j]], off[i:j + 1] - off[i])
                    best[i:j] = bits.argmin(1)
                    prob[i:j] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            names = np.array(m.langs or ["und"], object)
            return [pa.array(names[best], pa.string()), pa.array(prob)]
        return f

    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (lang_out.lower(), score_out.lower())]
    out = map_text(src, text_col, [(lang_out, "string"), (score_out, "double")], make, kept + [inner])
    return out.select(*[F.col(f"`{c}`") for c in kept],
                      F.when(F.col(inner), F.col(lang_out)).otherwise("und").alias(lang_out),
                      F.when(F.col(inner), F.col(score_out)).otherwise(0.0).alias(score_out))
