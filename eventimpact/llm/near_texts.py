"""Near-duplicate texts by BagMinHash: Poisson-process signatures of weighted word shingles, bands, exact overlap."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import map_text, mix, slices, tidy, utf8, word_hashes, written

WORDS = 5                 # words of a shingle
BANDS, ROWS = 24, 5       # a pair of similarity 0.8 shares no band with a chance of 7e-5
SIZE = BANDS * ROWS
KEY = np.uint64((1 << 48) - 1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit hash, text) of every run of WORDS words, ASCII letters lower-cased; a shorter text is one run."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    h, words = word_hashes(data, off)
    count = np.where(words > 0, np.maximum(1, words - WORDS + 1), 0)
    first = np.cumsum(words) - words
    text = np.repeat(np.arange(len(words)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + first[text]
    end = (first + words)[text]
    s = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        s = s * STEP + np.where(at + k < end, h[np.minimum(at + k, max(len(h) - 1, 0))], np.uint64(k + 1))
    return mix(s) & KEY, text


def bag(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, multiplicity) of the distinct shingles of at most 65,536 texts, ordered by text and hash."""
    s, text = shingles(data, off)
    key, n = np.unique((text.astype(np.uint64) << np.uint64(48)) | s, return_counts=True)
    return key & KEY, (key >> np.uint64(48)).astype(np.int64), n


def signatures(s: np.ndarray, text: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """BagMinHash signatures (n x SIZE): component i holds the point of smallest time among those of index i.

    The weights 0 .. w of an element are cut at 1, 2, 4, 8, ... Each interval below w has a Poisson process of a
    rate equal to its length, the same in every text: its points carry a time, an index and a position, and count
    if their position is below w. A process goes on until its time exceeds the largest smallest time of the text
    so far, as no later point can matter.
    """
    proc, level = [np.arange(len(s))], [np.zeros(len(s), np.int64)]
    top = 0
    while len(proc[-1]):
        more = proc[-1][weight[proc[-1]] > (1 << top)]
        proc.append(more)
        level.append(np.full(len(more), top + 1))
        top += 1
    proc, level = np.concatenate(proc), np.concatenate(level)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0).astype(np.float64)
    size = np.where(level > 0, low, 1.0)
    state = mix(s[proc] ^ mix(level.astype(np.uint64) + np.uint64(77)))
    owner, w = text[proc], weight[proc].astype(np.float64)
    best = np.full(n * SIZE, np.inf)
    sig = np.zeros(n * SIZE, np.uint64)
    time, done, run = np.zeros(len(proc)), 0, 1
    while len(state):
        k = np.arange(done + 1, done + run + 1, dtype=np.uint64)
        r = mix(state[:, None] + k[None, :] * STEP)
        gap = -np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / size[:, None]
        t = time[:, None] + np.cumsum(gap, 1)
        r2 = mix(r ^ STEP)
        cell = owner[:, None] * SIZE + ((r2 >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
        place = low[:, None] + size[:, None] * ((r2 & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        ok = place < w[:, None]
        cell, tt, point = cell[ok], t[ok], r[ok]
        maybe = tt < best[cell]
        cell, tt, point = cell[maybe], tt[maybe], point[maybe]
        np.minimum.at(best, cell, tt)
        won = tt == best[cell]
        sig[cell[won]] = point[won]
        limit = best.reshape(n, SIZE).max(1)
        on = t[:, -1] < limit[owner]
        state, owner, w, low, size, time = state[on], owner[on], w[on], low[on], size[on], t[on, -1]
        done, run = done + run, min(64, run if done == 0 else run * 2)
    return sig.reshape(n, SIZE)


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(sig), 0)
    for k in range(ROWS):
        h = mix(h * STEP + sig.reshape(len(sig), BANDS, ROWS)[:, :, k])
    return h.view(np.int64)


def overlaps(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in common, shingles in all) of two columns of texts, row by row, counted with multiplicity."""
    (da, oa), (db, ob) = utf8(a), utf8(b)
    common, total = np.zeros(len(oa) - 1, np.int64), np.zeros(len(oa) - 1, np.int64)
    for lo in range(0, len(common), 256):
        hi = min(lo + 256, len(common))
        x, y = (bag(d[o[lo]:o[hi]], o[lo:hi + 1] - o[lo]) for d, o in ((da, oa), (db, ob)))
        at, hit = _find(x, y)
        common[lo:hi] = np.bincount(x[1][hit], np.minimum(x[2][hit], y[2][at[hit]]), hi - lo)
        total[lo:hi] = np.bincount(x[1], x[2], hi - lo) + np.bincount(y[1], y[2], hi - lo)
    return common, total


def _find(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle of the bags ``x`` its place in the bags ``y`` of the same rows, and whether it is there."""
    kx, ky = (z[0] | (z[1].astype(np.uint64) << np.uint64(48)) for z in (x, y))
    if not len(ky):
        return np.zeros(len(kx), np.int64), np.zeros(len(kx), bool)
    at = np.minimum(np.searchsorted(ky, kx), len(ky) - 1)
    return at, ky[at] == kx


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``same`` (identity of the text), ``weight`` (shingles) and ``bands``, for every text with a word."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), text.alias("text")).filter(text.isNotNull()).withColumn("same", identity(F.col("text")))

    def make():
        def f(texts):
            data, off = utf8(texts)
            n = len(off) - 1
            sig, total = np.zeros((n, SIZE), np.uint64), np.zeros(n, np.int64)
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i, j in slices(off, 1 << 20, 1 << 15):
                s, t, w = bag(data[off[i]:off[j]], off[i:j + 1] - off[i])
                parts.append((s, t + i, w))
            s, t, w = (np.concatenate(x) for x in zip(*parts))
            if len(s):
                sig = signatures(s, t, w, n)
                total = np.bincount(t, w, n).astype(np.int64)
            keys = band_keys(sig)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
            return [pa.array(total), bands]
        return f

    return map_text(src, "text", [("weight", "long"), ("bands", "array<long>")], make, ["id", "same"], 2 << 20).filter("weight > 0")


def near_classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``class_id`` (smallest id of the class) and ``kept`` (id = class_id) of every row.

    Two texts are linked if their multisets of five-word shingles (white space between words, ASCII case ignored)
    have a weighted Jaccard similarity of at least ``least`` (``text_classes``); classes are what hangs together.

    Null texts, texts without a word and null ids are classes of their own (a null id: null class). A text of fewer
    than five words is one shingle. Rows that repeat an id are one document: their texts hang together. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = docs.filter(F.col(id_col).isNotNull())
    sig = written(sketches(rows, id_col, text_col), "sketches")
    classes = text_classes(rows, sig, least, id_col, text_col)
    # a text without a word has no sketch and is no node; a document may repeat an id with and without words
    named = rows.select(F.col(id_col).alias("id"), identity(F.col(text_col).cast("string")).alias("node"))
    mark = F.coalesce(F.xxhash64("node"), F.lit(0))
    twice = written(named.groupBy("id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo <> hi").select("id"), "twice")
    tied = None
    if not twice.isEmpty():
        tied = written(named.filter("node is not null").join(twice, "id"), "tied")
        ties = tied.join(tied.groupBy("id").agg(F.min("node").alias("u")), "id").select("u", F.col("node").alias("v"))
        classes = joined_classes(classes, ties)
    of_text = sig.groupBy(F.col("same").alias("node")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    of_text = written(of_text.join(classes, "node", "left").filter("component is not null or n > 1"), "classes")
    ids = of_text.select("component", "id")
    if tied is not None:
        ids = ids.unionAll(tied.join(classes, "node").select("component", "id"))
    first = ids.filter("component is not null").groupBy("component").agg(F.min("id").alias("class_id"))
    class_of = of_text.filter("component is null").select(F.col("node").alias("__node"), F.col("id").alias("class_id"))
    class_of = class_of.unionAll(of_text.join(first, "component").select("node", "class_id"))
    out = docs.select(F.col(id_col).alias("id"), identity(F.col(text_col).cast("string")).alias("node"))
    out = out.join(class_of, F.col("node") == F.col("__node"), "left").select("id", "class_id")
    if tied is not None:
        of_id = tied.join(class_of, F.col("node") == F.col("__node")).groupBy("id").agg(F.min("class_id").alias("__class"))
        out = out.join(of_id, "id", "left").select("id", F.coalesce("__class", "class_id").alias("class_id"))
    found = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    return out.select(F.col("id").alias(id_col), found.alias("class_id"), F.coalesce(F.col("id") == found, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class of texts the row of smallest id stays.

    Classes are those of texts (``text_classes``): of rows that repeat an id with different texts, both can stay. Of
    rows of one id and one text the one of smallest hash over all columns stays, rows without an id come last. Null
    texts and texts without a word all stay.
    """
    own = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                        identity(F.col(f"`{text_col}`").cast("string")).alias("node"), F.xxhash64(*[F.col(f"`{c}`") for c in own]).alias("hash"))
    sig = written(sketches(docs, id_col, text_col), "sketches")
    classes = text_classes(docs, sig, least, id_col, text_col)
    wordy = sig.select(F.col("same").alias("node")).distinct()
    rows = keyed.select("id", "node", "hash").join(wordy, "node", "left_semi").join(classes, "node", "left")
    rank = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("node").alias("c"), F.col("hash").alias("d"))
    best = written(rows.groupBy(F.coalesce("component", "node").alias("g")).agg(F.min(rank).alias("r")), "kept")
    best = best.select(F.col("r.c").alias("_node"), F.col("r.d").alias("_hash"), F.col("r.b").alias("_id"))
    same_row = (F.col("node") == F.col("_node")) & (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id"))
    kept = keyed.join(best, same_row, "left_semi").dropDuplicates(["node", "hash"])
    rest = keyed.join(wordy, "node", "left_anti")
    return kept.select("row").unionAll(rest.select("row")).select("row.*")


TAKES, PART = 16, 32     # a bucket gets another centre while one takes at least TAKES texts and one in PART of those left
SALT = 16                # parts into which the texts of one centre are dealt


def text_classes(docs: DataFrame, sig: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """``node`` (identity of a text) and ``component`` of the texts that hang together with others.

    Candidates share a band of the signature; each link is verified on the whole texts. Equal texts are one node.
    Pairs of a bucket are not listed. In rounds, all texts of a bucket that no centre has taken yet are compared with a
    new centre, the one among them that meets most others; near ones are taken. This goes on while centres take a
    fair part of what is left, so a text is compared a bounded number of times in each of its buckets, however large
    the bucket is. A pair of a bucket that is not taken by one centre was compared with a common centre that is not
    near one of them; such pairs are found by what the two have in common in their differences from it (``missing``).
    """
    reps = sig.groupBy(F.col("same").alias("node")).agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("weight").alias("weight"))
    rows = written(reps.select("node", "id", "weight", F.explode(F.array_distinct("bands")).alias("bucket")), "bands")
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = F.sum("n").over(Window.partitionBy("node"))                          # with how many texts it shares a bucket
    shared = written(rows.join(full, "bucket").withColumn("met", met), "shared")
    body = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("node", identity(F.col("text")))
    wanted = shared.select(F.col("node").alias("__node"), F.col("id").alias("__id")).distinct()
    body = body.join(wanted, (F.col("node") == F.col("__node")) & F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    texts = written(body.select("node", "text").dropDuplicates(["node"]), "texts")

    left, judged = shared.select("bucket", "node", "weight", "met"), []
    union = lambda parts: functools.reduce(DataFrame.unionAll, parts)
    while not left.isEmpty():
        first = left.groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("c"), F.count(F.lit(1)).alias("n"))
        stars = left.join(first.select("bucket", "n", F.col("c.node").alias("c")), "bucket").filter("node <> c")
        pairs = stars.groupBy("node", "c", "weight", "met").agg(F.collect_list(F.struct("bucket", "n")).alias("in"))     # at most BANDS
        now = verify(pairs, texts, ["weight", "met", "in"]).withColumn("near", F.col("similarity") >= least)
        now = written(now.select("node", "c", "weight", "met", "near", F.explode("in").alias("b")).select("node", "c", "weight", "met", "near", "b.*"), "stars")
        took = now.groupBy("bucket").agg(F.sum(F.col("near").cast("long")).alias("k"), F.first("n").alias("n"))
        on = took.filter(f"k >= {TAKES} and k * {PART} >= n and n - 1 - k > 1").select("bucket", F.lit(True).alias("on"))
        now = written(now.join(on, "bucket", "left").withColumn("last", F.col("on").isNull()), "judged")
        judged.append(now.select("c", "node", "weight", "near", "last"))
        left = now.filter("not last and not near").select("bucket", "node", "weight", "met")
    if not judged:
        return rows.select("node", F.col("node").alias("component")).filter("false")
    judged = union(judged)
    links = judged.filter("near").select(F.col("node").alias("u"), F.col("c").alias("v"))
    classes = connected_components(links, stars=True)
    rest = missing(judged, classes, texts, least)
    more = written(verify(rest, texts).filter(F.col("similarity") >= least).select(F.col("node").alias("u"), F.col("c").alias("v")), "links")
    return joined_classes(classes, more)


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (node, component) after further links (u, v) between nodes, of which some may be in no class yet:
    only the classes that links touch are contracted."""
    if links.isEmpty():
        return classes
    of = classes.select("node", "component")
    ends = links.join(of.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
    ends = ends.join(of.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    ends = written(ends.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")), "ends")
    top = connected_components(ends, stars=True).select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = classes.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = top.join(of.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
    return written(moved.unionAll(alone), "classes")


def of_group(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with the one row of their group; the rows of a group are dealt to SALT tasks."""
    salt = F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("__salt")
    return rows.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")).join(groups.select("*", salt), [*keys, "__salt"]).drop("__salt")


def missing(judged: DataFrame, classes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (node, c) of different classes that may be near though no common centre took both.

    Say both were compared with the centre c, and A is not near it. For a text X let E be the shingles of c that X
    lacks and D those that X has beyond c, with multiplicity. Counting gives that A and X are near if and only if the
    differences that they have in common (of E_A and E_X, and of D_A and D_X) weigh at least g_A + g_X - base, where
    g = (1 - s) |E| + s |D|, s = t / (1 + t) and base = (1 - 2 s) |c|. As A is not near c, theta = g_A - base is
    positive: X must share at least g_X + theta of its differences, and A at least theta + g_X of its own. So with the
    differences in one order, rare ones first, both hold the rarest common one after the commonest of a total below
    that bound have been left out: an exact join on (centre, difference).

    A asks if it is not near c; X holds if it is near c or c was its bucket's last centre. Who finds only its own class
    on the other side is left out, and differences that nobody on the other side has are not counted.
    """
    share = least / (1 + least)
    pair = judged.groupBy("c", "node").agg(F.first("weight").alias("weight"), F.max("near").alias("near"), F.max("last").alias("last"))
    pair = pair.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    role = F.explode(F.filter(F.array(F.when(~F.col("near"), F.lit("a")), F.when(F.col("near") | F.col("last"), F.lit("h"))), lambda x: x.isNotNull()))
    roles = written(pair.select("c", "node", "weight", "class", role.alias("role")), "roles")
    other = F.when(F.col("role") == "a", "h").otherwise("a").alias("role")
    kinds = roles.groupBy("c", other).agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    roles = of_group(roles, kinds, ["c", "role"]).filter("not (lo = class and hi = class)")
    both = roles.groupBy("c", "node", "weight", "class").agg(F.collect_list("role").alias("roles"))
    both = both.join(texts.withColumnRenamed("text", "tx"), "node")
    both = both.join(texts.select(F.col("node").alias("c"), F.col("text").alias("tc")), "c").select("node", "c", "tx", "tc", "weight", "class", "roles")
    features = pa.list_(pa.struct([("f", pa.int64()), ("m", pa.int64())]))

    def differ(parts):
        for b in parts:
            (dx, ox), (dc, oc) = utf8(b.column(2)), utf8(b.column(3))
            for lo in range(0, b.num_rows, 64):
                hi = min(lo + 64, b.num_rows)
                x, c = (bag(d[o[lo]:o[hi]], o[lo:hi + 1] - o[lo]) for d, o in ((dx, ox), (dc, oc)))
                rows, gap, sign = [], [], []
                for one, other, minus in ((x, c, False), (c, x, True)):
                    at, hit = _find(one, other)
                    m = one[2].copy()
                    m[hit] -= np.minimum(one[2][hit], other[2][at[hit]])
                    keep = m > 0
                    h = one[0][keep].astype(np.int64)
                    rows.append(one[1][keep])
                    gap.append(m[keep])
                    sign.append(~h if minus else h)
                row, m, f = (np.concatenate(z) for z in (rows, gap, sign))
                order = np.argsort(row, kind="stable")
                row, m, f = row[order], m[order], f[order]
                n = hi - lo
                more, less = (np.bincount(row[k], m[k], n) for k in (f >= 0, f < 0))
                g = (1 - share) * less + share * more
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(f), pa.array(m)], names=["f", "m"]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array(g),
                                                  pa.array(g - (1 - 2 * share) * np.bincount(c[1], c[2], n)), found.cast(features), *[b.column(k).slice(lo, n) for k in (4, 5, 6)]],
                                                 names=["node", "c", "g", "theta", "features", "weight", "class", "roles"])

    ddl = "node binary, c binary, g double, theta double, features array<struct<f:long,m:long>>, weight long, class binary, roles array<string>"
    base = written(both.mapInArrow(tidy(differ), ddl), "differences")
    twin = (F.size("roles") > 1).alias("twin")
    roles = base.select("c", "node", "weight", "class", twin, "g", "theta", "features", F.explode("roles").alias("role"))
    roles = roles.withColumn("own", F.when(F.col("role") == "a", F.col("theta")).otherwise(F.col("g")))
    bounds = roles.groupBy("c", other).agg(F.min("own").alias("least"))
    roles = of_group(roles, bounds, ["c", "role"]).withColumn("need", F.col("own") + F.col("least") - 1e-6)
    flat = roles.select("c", "node", "weight", "class", "twin", "role", "own", "need", F.explode("features").alias("s"))
    flat = written(flat.select("c", "node", "weight", "class", "twin", "role", "own", "need", "s.f", "s.m"), "features")
    asks = F.col("role") == "a"
    seen = flat.groupBy("c", "f").agg(F.sum(asks.cast("long")).alias("na"), F.sum((~asks).cast("long")).alias("nh"))
    useful = F.when(asks, F.col("nh")).otherwise(F.col("na")) > F.col("twin").cast("int")     # somebody else on the other side
    flat = flat.join(seen, ["c", "f"]).filter(useful)
    each = Window.partitionBy("c", "node", "role")
    so_far = F.sum("m").over(each.orderBy(F.desc(F.col("na") + F.col("nh")), "f").rowsBetween(Window.unboundedPreceding, 0))
    rare = flat.withColumn("so_far", so_far).withColumn("sum", F.sum("m").over(each)).filter("so_far >= need")
    rare = written(rare.select("c", "f", "node", "class", "role", "weight", "own", "sum"), "rare")
    a = rare.filter(asks).drop("role")
    h = rare.filter(~asks).select("c", "f", *[F.col(x).alias(f"x_{x}") for x in ("node", "class", "weight", "own", "sum")])
    fits = (F.col("class") != F.col("x_class")) & (F.col("node") != F.col("x_node")) & (F.least("weight", "x_weight") >= least * F.greatest("weight", "x_weight"))
    fits = fits & (F.col("own") + F.col("x_own") - 1e-6 <= F.least("sum", "x_sum"))
    pairs = a.join(h, ["c", "f"]).filter(fits).select(F.least("node", "x_node").alias("node"), F.greatest("node", "x_node").alias("c")).distinct()
    known = judged.select(F.least("node", "c").alias("node"), F.greatest("node", "c").alias("c"))
    return pairs.join(known.distinct(), ["node", "c"], "left_anti")


def verify(pairs: DataFrame, texts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(node, c, overlap, similarity) of pairs of nodes, on the whole texts, and the columns ``keep``."""
    from pyspark.sql.types import StructType
    keep = keep or []
    left = texts.select("node", F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("c"), F.col("text").alias("tb"))
    both = pairs.join(left, "node").join(right, "c").select("node", "c", "ta", "tb", *keep)
    own = StructType.fromDDL("node binary, c binary, overlap long, similarity double").fields
    schema = StructType(own + pairs.select(*keep).schema.fields)
    names = schema.names

    def run(parts):
        for b in parts:
            if b.num_rows:
                common, total = overlaps(b.column(2), b.column(3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(common), pa.array(common / np.maximum(total - common, 1)),
                                                  *b.columns[4:]], names=names)
    return both.mapInArrow(tidy(run), schema)


def identity(text):
    """128 bits that stand for a whole text (its length and MD5)."""
    return F.unhex(F.md5(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
