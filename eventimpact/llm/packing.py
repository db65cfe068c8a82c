"""Packing of documents into sequences by bin completion (branch and bound over the histogram of lengths)."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import cut_ids, library_coder
from .common import map_text, tidy, utf8, written


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n ids: whole, or full pieces behind a first one that may be shorter."""
    first = n % capacity or min(n, capacity)
    return [first] + [capacity] * ((n - first) // capacity)


def tokenised_pieces(df: DataFrame, path: str, capacity: int, text_col: str = "text", end_id: int = 0,
                     keep: list[str] | None = None) -> DataFrame:
    """One row per piece: the kept columns, ``piece`` (from 0), ``start`` (ids of the document before it),
    ``length`` and ``ids`` (little-endian unsigned 32-bit). A null or empty text is its end id alone."""
    end = np.array([end_id], "<u4").tobytes()

    def make():
        coder = library_coder(path)

        def f(texts):
            rows = []
            for got in cut_ids(*coder(*utf8(texts))):
                ids, at, row = got + end, 0, []
                for n in cut(len(ids) // 4, capacity):
                    row.append(ids[4 * at:4 * (at + n)])
                    at += n
                rows.append(row)
            return [pa.array(rows, pa.list_(pa.binary()))]
        return f

    new = ("piece", "start", "length", "ids", "__pieces")
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    wide = map_text(df, text_col, [("__pieces", "array<binary>")], make, keep, 1 << 20)
    long = wide.select(*[F.col(f"`{c}`") for c in keep], F.length(F.element_at("__pieces", 1)).alias("__first"),
                       F.posexplode("__pieces").alias("piece", "ids"))
    start = F.when(F.col("piece") == 0, 0).otherwise((F.col("__first") / 4).cast("long") + (F.col("piece") - 1) * capacity)
    return long.select(*[F.col(f"`{c}`") for c in keep], "piece", start.cast("long").alias("start"),
                       (F.length("ids") / 4).cast("long").alias("length"), "ids")


@dataclass
class Pattern:
    """``times`` bins that all hold the same lengths: (length, copies) in order."""
    items: list[tuple[int, int]]
    times: int


FRACTIONS = range(1, 33)      # the dual feasible functions that bounds are taken from


def fraction(size: int, capacity: int, k: int) -> int:
    """Share of a bin that a length takes at least, in k (k + 1)-ths, by the k-th dual feasible function: with
    m = (k + 1) size / capacity it is m / (k + 1) if m is whole, else floor(m) / k. The shares of lengths that fit one
    bin never exceed it, so their sum over all lengths bounds the bins from below. k = 1 counts lengths above half."""
    m, odd = divmod((k + 1) * size, capacity)
    return m * (k + 1) if odd else m * k


def dominates(a: list[int], b: list[int]) -> bool:
    """Whether the lengths of ``b`` can be dealt to those of ``a`` so that none is overfull (long fillings: not decided).
    A packing that holds filling b can then swap them and hold a instead."""
    if len(b) > 12 or sum(b) > sum(a):
        return False
    b = sorted(b, reverse=True)

    def deal(i: int, rooms: tuple[int, ...]) -> bool:
        if i == len(b):
            return True
        for j, room in enumerate(rooms):
            if room >= b[i] and (j == 0 or rooms[j - 1] != room):
                if deal(i + 1, tuple(sorted((*rooms[:j], room - b[i], *rooms[j + 1:]), reverse=True))):
                    return True
        return False
    return deal(0, tuple(sorted(a, reverse=True)))


def lower_bound(count: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the largest of the total, the Martello-Toth bounds and those of ``fraction``."""
    total = sum(n * c for n, c in count.items())
    best = -(-total // capacity)
    sizes = sorted(count)
    for k in [0, *[s for s in sizes if 2 * s <= capacity]]:
        big = sum(c for s, c in count.items() if s > capacity - k)
        mid = [(s, c) for s, c in count.items() if capacity - k >= s and 2 * s > capacity]
        small = sum(s * c for s, c in count.items() if 2 * s <= capacity and s >= k)
        room = sum(c for _, c in mid) * capacity - sum(s * c for s, c in mid)
        best = max(best, big + sum(c for _, c in mid) + max(0, -(-(small - room) // capacity)))
    for k in FRACTIONS:
        best = max(best, -(-sum(c * fraction(s, capacity, k) for s, c in count.items()) // (k * (k + 1))))
    return best


class _Search:
    """Depth-first bin completion. A node fills bins around the largest length left; ``count`` is changed in place
    and put back on the way up."""

    def __init__(self, count: dict[int, int], capacity: int, width: int, few: bool):
        self.count, self.capacity, self.width, self.few = dict(count), capacity, width, few
        self.sizes = sorted(s for s, c in count.items() if c > 0)
        self.rest = sum(s * c for s, c in count.items())
        # shares of a bin of all that is left, for the bounds that tell most at the root
        ks = sorted(FRACTIONS, key=lambda k: -sum(c * fraction(s, capacity, k) for s, c in count.items()) / (k * (k + 1)))[:4]
        self.scale = [k * (k + 1) for k in ks]
        self.share = {s: [fraction(s, capacity, k) for k in ks] for s in count}
        self.shares = [sum(c * self.share[s][i] for s, c in count.items()) for i in range(len(ks))]

    def least(self) -> int:
        """Bins that what is left needs at least."""
        return max(-(-self.rest // self.capacity), *(-(-x // z) for x, z in zip(self.shares, self.scale)))

    def weigh(self, item: int, n: int) -> None:
        self.rest += n * item
        for i, x in enumerate(self.share[item]):
            self.shares[i] += n * x

    def take(self, item: int, n: int) -> None:
        before = self.count.get(item, 0)
        self.count[item] = before - n
        self.weigh(item, -n)
        if before and before == n:
            del self.sizes[bisect.bisect_left(self.sizes, item)]
        elif not before:
            bisect.insort(self.sizes, item)

    def largest(self, room: int, used: dict[int, int]) -> int:
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0 and self.count[self.sizes[i]] <= used.get(self.sizes[i], 0):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def fill(self, chosen: list[int], room: int, used: dict[int, int]) -> tuple[int, list[int]]:
        """Best fit until nothing fits (a filling that leaves room for more is dominated)."""
        used, chosen = dict(used), list(chosen)
        for x in chosen:
            used[x] = used.get(x, 0) + 1
            room -= x
        while room and (x := self.largest(room, used)):
            k = min(room // x, self.count[x] - used.get(x, 0))
            used[x] = used.get(x, 0) + k
            chosen += [x] * k
            room -= x * k
        return room, chosen

    def completions(self) -> list[tuple[int, int, list[int]]]:
        """(waste, items, filling) of the undominated fillings found around the largest length: the largest single
        that fits, and pairs that fill more than it does, each made maximal. Least waste first, then the largest item
        or, with ``few``, the fewest items, which leaves short lengths for the gaps of later bins."""
        top = self.sizes[-1]
        room, used = self.capacity - top, {top: 1}
        one = self.largest(room, used)
        if not one:
            return [(room, 0, [])]
        if one == room:
            return [(0, 1, [one])]
        found = [self.fill([one], room, used)]
        if not found[0][0] and not self.few:
            return [(0, 0, found[0][1])]
        sizes = np.array(self.sizes[:bisect.bisect_right(self.sizes, room)])
        mate = np.searchsorted(sizes, room - sizes, "right") - 1
        both = np.where(mate >= 0, sizes + sizes[np.maximum(mate, 0)], 0)
        both[(sizes < sizes[np.maximum(mate, 0)]) | (both <= one)] = 0
        for i in np.argsort(-both, kind="stable")[:4 * self.width]:
            if not both[i] or len(found) > self.width:
                break
            x, y = int(sizes[i]), int(sizes[mate[i]])
            need = {top: 1}
            for z in (x, y):
                need[z] = need.get(z, 0) + 1
            if all(self.count[z] >= k for z, k in need.items()):
                found.append(self.fill([x, y], room, used))
        unique = {tuple(sorted(items)): (waste, len(items) if self.few else -max(items), items) for waste, items in found}
        return sorted(unique.values())[:self.width]

    def maximal(self):
        """Every filling around the largest length that leaves no room for a length left; None at a dead end."""
        top = self.sizes[-1]
        sizes = list(self.sizes)
        have = [self.count[s] - (s == top) for s in sizes]
        below = np.cumsum([0] + [s * n for s, n in zip(sizes, have)]).tolist()

        def fill(room: int, end: int, skipped: int, chosen: list[int]):
            # ``skipped``: the smallest length passed over, which must not fit in the end
            ended = True
            for j in range(min(end, bisect.bisect_right(sizes, room)) - 1, -1, -1):
                s, n = sizes[j], have[j]
                if not n:
                    continue
                if room - below[j + 1] >= skipped:
                    yield None
                    return
                ended = False
                for k in range(min(n, room // s), 0, -1):
                    yield from fill(room - k * s, j, s if k < n else skipped, chosen + [s] * k)
                skipped = s
            yield chosen if ended and room < skipped else None

        yield from fill(self.capacity - top, len(sizes), self.capacity + 1, [])

    def need(self, filling: list[int]) -> dict[int, int]:
        need = {self.sizes[-1]: 1}
        for x in filling:
            need[x] = need.get(x, 0) + 1
        return need

    def branches(self, whole: bool = True):
        """(filling, how often at most) of a node, None at a dead end: first what ``completions`` finds, as often as it
        goes, then, if ``whole``, the same once only and every other maximal filling that none before ``dominates``. One
        length that fits exactly, or none that fits, dominates the rest."""
        found = [f for _, _, f in self.completions()]
        yield from ((f, self.rest) for f in found)
        if not whole or not found[0] or found[0] == [self.capacity - self.sizes[-1]]:
            return
        known = {tuple(sorted(f)) for f in found}
        often = lambda f: min(self.count[x] // k for x, k in self.need(f).items()) > 1
        yield from ((f, 1) for f in found if often(f))
        tried = list(found)
        for f in self.maximal():
            if f is None or any(dominates(a, f) for a in tried[:64] if tuple(sorted(f)) not in known):
                yield None
            elif tuple(sorted(f)) not in known:
                tried.append(f)
                yield f, self.rest
                if often(f):
                    yield f, 1

    def apply(self, filling: list[int], most: int) -> tuple[Pattern, dict[int, int]]:
        need = self.need(filling)
        times = min(most, *(self.count[x] // k for x, k in need.items()))
        for x, k in need.items():
            self.take(x, k * times)
        return Pattern(list(need.items()), times), need

    def undo(self, step: tuple[Pattern, dict[int, int]]) -> None:
        for x, k in step[1].items():
            self.put(x, k * step[0].times)

    def put(self, item: int, n: int) -> None:
        if not self.count.get(item, 0):
            bisect.insort(self.sizes, item)
        self.count[item] = self.count.get(item, 0) + n
        self.weigh(item, n)


def complete_bins(count: dict[int, int], capacity: int, width: int = 4, nodes: int = 20_000) -> list[Pattern]:
    """Patterns that use up the histogram ``count`` (length -> number) in as few bins as the search finds.

    The first descent always takes the filling of least waste, which is best fit, and gives the incumbent. The
    search then backs up and tries the other fillings; a node is cut off when the bins so far and the waste bound
    of the rest cannot beat the incumbent. It ends when the lower bound is met, the tree is exhausted, or after
    ``nodes`` nodes and dead ends beyond the first descent (the incumbent stands; the packing is whole in any case). It runs once
    for each order of equally good fillings over the best ``width`` fillings of a node, then over all maximal fillings
    and fewer repeats of one, and the best packing counts.
    """
    bound, best = lower_bound(count, capacity), None
    for whole, few in ((False, False), (False, True), (True, False), (True, True)):
        got = _branch_and_bound(_Search(count, capacity, width, few), bound, nodes, whole)
        if best is None or sum(p.times for p in got) < sum(p.times for p in best):
            best = got
        if sum(p.times for p in best) <= bound:
            break
    return best


def _branch_and_bound(search: _Search, bound: int, nodes: int, whole: bool) -> list[Pattern]:
    best, best_bins, spent = None, float("inf"), 0
    if not search.sizes:
        return []
    path, choices, bins, end = [], [search.branches(whole)], 0, object()
    while choices:
        if best is not None:
            spent += 1
            if best_bins <= bound or spent > nodes:
                break
        got = next(choices[-1], end) if bins + search.least() < best_bins else end
        if got is None:
            continue
        if got is end:
            choices.pop()
            if path:
                step = path.pop()
                bins -= step[0].times
                search.undo(step)
            continue
        path.append(search.apply(*got))
        bins += path[-1][0].times
        if search.sizes:
            choices.append(search.branches(whole))
            continue
        if bins < best_bins:
            best, best_bins = [p for p, _ in path], bins
        choices.append(iter(()))
    return best


def plan_runs(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in each sequence, offset of the first copy): the pieces of
    a length, numbered from 0, are dealt to the sequences run by run. Sorted by length and first rank."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for p in patterns:
        at = 0
        for length, copies in p.items:
            rows.append((length, rank.get(length, 0), base, copies, at))
            rank[length] = rank.get(length, 0) + copies * p.times
            at += length * copies
        base += p.times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int, order: list[str], length_col: str = "length", group: int = 50_000,
         nodes: int = 20_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every row: no sequence holds more than ``capacity``, offsets are
    gapless from 0.

    Only the histogram of lengths (at most ``capacity`` rows) is planned on the driver. Pieces of one length are
    interchangeable; they are numbered in groups of about ``group`` rows, split by a hash of the ``order`` columns,
    so a hot length is many tasks. Repeated rows are packed once each; an empty table gives an empty result.
    Clashing columns are replaced. Every length must be from 1 to ``capacity``.
    """
    keep = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    pieces = pieces.select(*[F.col(f"`{c}`") for c in keep])
    spark, n = pieces.sparkSession, F.col(f"`{length_col}`").cast("long")
    count = {int(r[0]): int(r[1]) for r in pieces.groupBy(n.alias("n")).count().collect()}
    runs = plan_runs(complete_bins(count, capacity, nodes=nodes))
    groups = spark.createDataFrame([(k, -(-c // group)) for k, c in count.items()] or [(0, 1)], "__n long, __groups long")
    rows = pieces.withColumn("__n", n).join(F.broadcast(groups), "__n")              # at most `capacity` rows
    rows = rows.withColumn("__g", F.pmod(F.xxhash64(*order), F.col("__groups")))
    sizes = rows.groupBy("__n", "__g").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.withColumn("__before", F.sum("__c").over(
        Window.partitionBy("__n").orderBy("__g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c"))
    inside = F.row_number().over(Window.partitionBy("__n", "__g").orderBy(*order)) - 1
    ranked = rows.withColumn("__i", inside).join(before.select("__n", "__g", "__before"), ["__n", "__g"])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in keep], "__n", (F.col("__i") + F.col("__before")).cast("long").alias("__rank"))
    shared = spark.sparkContext.broadcast(runs)
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = ranked.drop("__n", "__rank").schema.add("sequence_id", "long").add("offset", "long")
    arrow = to_arrow_schema(schema)

    def place(parts):
        table = shared.value
        key = table[:, 0] << 44 | table[:, 1]
        for b in parts:
            length, rank = (np.asarray(b.column(i)).astype(np.int64) for i in (-2, -1))
            _, first, base, copies, at = table[np.searchsorted(key, length << 44 | rank, "right") - 1].T
            cols = [*b.columns[:-2], pa.array(base + (rank - first) // copies), pa.array(at + (rank - first) % copies * length)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, arrow.types)], schema=arrow)

    return ranked.mapInArrow(tidy(place), schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 0) -> DataFrame:
    """Documents to packed pieces: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.
    The ids themselves are in ``tokenised_pieces``."""
    p = tokenised_pieces(docs, path, capacity, text_col, end_id, [id_col])
    p = written(p.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(p, capacity, [id_col, "piece", "ids_crc32"])
