"""Spelling variants: words one edit apart, found by k-d trees over letter counts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, partitions, tidy, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\\u00C0-\\u00FF]"
LETTERS = 26 + 64                 # a-z, and U+00C0 to U+00FF
SAMPLE = 50_000                   # words that the upper tree's cuts are taken from (any cuts give the same result)
CELL, LEAF, ASK = 16_384, 48, 4096  # words of a cell of the upper tree, of a leaf of a cell's own tree; words asking at a time
EDIT = {0: (1, 1), 1: (1, 0), -1: (0, 1)}    # letters that a partner has more and less, by how much longer it is


def count_words(docs: DataFrame, least_length: int = 6, least_n: int = 5, drop: int = 199, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``word``, ``n``: the maximal runs of letters of whole texts, A-Z lower-cased, of at least ``least_length`` code
    points and ``least_n`` occurrences. Where ``drop`` divides h = crc32("<id>:<run>"), the run's code point
    h % length (from 0) is left out."""
    text = F.col(text_col).cast("string")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = low.withColumn("h", h).select(F.when(F.col("h") % drop == 0, cut).otherwise(F.col("run")).alias("word"))
    got = word.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return got.filter(F.col("n") >= least_n)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words in a row, lengths)."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.array([len(w) for w in words], np.int64)


def letter_counts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each word (n x LETTERS)."""
    letter = np.where(points < 128, points.astype(np.int64) - 97, points.astype(np.int64) - 0xC0 + 26)
    row = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(row * LETTERS + letter, minlength=len(lengths) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


def build(counts: np.ndarray, size: int, leaves: list) -> tuple:
    """k-d tree: (letter, most, words with at most so many, the others) or (leaf number,); the members of leaf i are
    ``leaves[i]``. A node is cut at the median of the letter that spreads most, down to ``size`` words or equal counts."""
    def node(at):
        part = counts[at]
        if len(at) > size:
            spread = part.astype(np.float64).var(0)
            for d in np.argsort(-spread, kind="stable")[:8]:
                if not spread[d]:
                    break
                cut = int(np.median(part[:, d]))
                cut = min(cut, int(part[:, d].max()) - 1)
                left = part[:, d] <= cut
                if left.any() and not left.all():
                    return int(d), cut, node(at[left]), node(at[~left])
        leaves.append(at)
        return (len(leaves) - 1,)
    return node(np.arange(len(counts)))


def reach(tree: tuple, counts: np.ndarray, most_up: int, most_down: int):
    """(leaf, rows of ``counts``) of the leaves whose box a word of such counts can enter by at most ``most_up`` letters
    more and ``most_down`` letters less: the distance to a box grows cut by cut."""
    lo, hi = np.zeros(LETTERS, np.int64), np.full(LETTERS, 1 << 40)

    def walk(node, at, up, down):
        if not len(at):
            return
        if len(node) == 1:
            yield node[0], at
            return
        d, cut, left, right = node
        x = counts[at, d].astype(np.int64)
        was = hi[d]
        more = down + np.maximum(x - cut, 0) - np.maximum(x - was, 0)
        ok = more <= most_down
        hi[d] = cut
        yield from walk(left, at[ok], up[ok], more[ok])
        hi[d], was = was, lo[d]
        more = up + np.maximum(cut + 1 - x, 0) - np.maximum(was - x, 0)
        ok = more <= most_up
        lo[d] = cut + 1
        yield from walk(right, at[ok], more[ok], down[ok])
        lo[d] = was

    zero = np.zeros(len(counts), np.int64)
    yield from walk(tree, np.arange(len(counts)), zero, zero)


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether word i of ``x`` and word j of ``y`` (code points, a row a word) are one edit apart; lengths differ by at most 1."""
    if x.shape[1] == y.shape[1]:
        return (x[:, None, :] != y[None, :, :]).sum(2) == 1
    if x.shape[1] > y.shape[1]:
        return one_edit(y, x).T
    n = x.shape[1]
    head = np.logical_and.accumulate(x[:, None, :] == y[None, :, :n], axis=2).sum(2)
    tail = np.logical_and.accumulate((x[:, None, :] == y[None, :, 1:])[:, :, ::-1], axis=2).sum(2)
    return head + tail >= n


class Cell:
    """The words of one cell (all of one length, in code-point order), with a k-d tree of their own."""

    def __init__(self, words: list[str], n: np.ndarray):
        points, lengths = code_points(words)
        self.words, self.n, self.length = words, n, int(lengths[0])
        self.points = points.reshape(len(words), -1)
        self.leaves: list = []
        counts = letter_counts(points, lengths)
        self.tree = build(counts, LEAF, self.leaves)
        self.box = [(counts[a].min(0), counts[a].max(0)) for a in self.leaves]

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``words``, word of the cell) of the pairs one edit apart; ``words`` are of one length."""
        points, lengths = code_points(words)
        x, counts = points.reshape(len(words), -1), letter_counts(points, lengths)
        up, down = EDIT[self.length - x.shape[1]]
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for leaf, at in reach(self.tree, counts, up, down):
            lo, hi = self.box[leaf]
            c = counts[at]
            at = at[(np.maximum(lo - c, 0).sum(1) <= up) & (np.maximum(c - hi, 0).sum(1) <= down)]
            mine = self.leaves[leaf]
            step = max(1, (1 << 22) // (len(mine) * x.shape[1]))
            many = max(1, (1 << 22) // x.shape[1])
            for i in range(0, len(at), step):
                for j in range(0, len(mine), many):
                    a, b = np.nonzero(one_edit(x[at[i:i + step]], self.points[mine[j:j + many]]))
                    rows.append(at[i + a])
                    cols.append(mine[j + b])
        return np.concatenate(rows), np.concatenate(cols)


def upper_trees(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, tuple]:
    """For each length of word a tree that cuts the words into cells: (tree, number of its first cell, parts of each
    cell). A cell that cannot be cut further, but holds many words by the sample, is dealt to several parts by hash."""
    total = words.count()
    share = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(min(1.0, sample / max(total, 1)) * (1 << 30))
    some = sorted(r.word for r in words.filter(share).select("word").collect())       # about ``sample`` words
    by_length: dict[int, list] = {}
    for w in some:
        by_length.setdefault(len(w), []).append(w)
    each, first, out = max(1.0, total / max(len(some), 1)), 0, {}
    for length in sorted(by_length):
        leaves: list = []
        tree = build(letter_counts(*code_points(by_length[length])), max(1, int(cell / each)), leaves)
        out[length] = (tree, first, [max(1, math.ceil(len(x) * each / (4 * cell))) for x in leaves])
        first += len(leaves)
    return out


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """For every word of ``words`` (word, n; distinct) that has near words: ``word``, ``n_near``, ``best_n`` and
    ``best``, the near word of largest n (ties: the first in code-point order).

    Words are near if one inserted, deleted or replaced code point apart: then a partner of equal length has at most
    one letter more and one less, a longer one just one more. A tree for each length cuts the words into cells; a word
    goes to its own cell as a member and to all cells that its partners can be in as an asker; each cell searches its
    own tree and compares letter by letter. Askers yield a count and a best word by cell, no pairs leave a task.
    """
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(upper_trees(words, sample, cell))
    schema = pa.schema([("cell", pa.int64()), ("part", pa.int32()), ("asks", pa.int8()), ("length", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def deal(parts):
        trees = shared.value
        for b in parts:
            text, n = b.column(0).to_pylist(), np.asarray(b.column(1))
            number = np.asarray(b.column(2))
            lengths, out = np.array([len(w) for w in text], np.int64), []
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                counts = letter_counts(*code_points([text[i] for i in at]))
                for plus, (up, down) in [(None, (0, 0)), *EDIT.items()]:
                    tree, first, split = trees.get(int(length) + (plus or 0), ((0,), -1 - int(length) - (plus or 0), [1]))
                    for leaf, rows in reach(tree, counts, up, down):
                        to = at[rows]
                        for part in range(split[leaf]):
                            go = to if plus is not None else to[number[to] % split[leaf] == part]
                            out.append((go, np.full(len(go), first + leaf), np.full(len(go), part), np.full(len(go), plus is not None)))
            if out:
                go, cells, split_no, asks = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([
                    pa.array(cells, pa.int64()), pa.array(split_no.astype(np.int32)), pa.array(asks.astype(np.int8)),
                    pa.array(lengths[go].astype(np.int32)), b.column(0).take(pa.array(go)), pa.array(n[go])], schema=schema)

    def search(parts):
        where, members, weights, cell_ = None, [], [], None
        for b in parts:
            place, asks, length = np.asarray(b.column(0)) * 4096 + np.asarray(b.column(1)), np.asarray(b.column(2)), np.asarray(b.column(3))
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(asks) != 0) | (np.diff(length) != 0)) + 1
            for i, j in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [b.num_rows]])):
                if i == j:
                    continue
                key = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if key != where:
                    where, members, weights, cell_ = key, [], [], None
                text = b.column(4).slice(i, j - i).to_pylist()
                if not asks[i]:
                    members += text
                    weights.append(np.asarray(b.column(5).slice(i, j - i)))
                    continue
                if not members:
                    continue
                cell_ = cell_ or Cell(members, np.concatenate(weights))
                for k in range(0, len(text), ASK):
                    row, col = cell_.near(text[k:k + ASK])
                    if len(row):
                        order = np.lexsort((col, -cell_.n[col], row))
                        row, col = row[order], col[order]
                        new = np.flatnonzero(np.diff(row, prepend=-1))
                        yield pa.RecordBatch.from_arrays([
                            pa.array([text[k + r] for r in row[new]]), pa.array(np.diff(np.append(new, len(row)))), pa.array(cell_.n[col[new]]),
                            pa.array([cell_.words[c] for c in col[new]])], names=["word", "n_near", "best_n", "best"])

    number = F.pmod(F.xxhash64("word"), F.lit(1 << 20)).cast("int")
    dealt = words.select("word", "n", number.alias("number")).mapInArrow(tidy(deal), "cell long, part int, asks byte, length int, word string, n long")
    dealt = dealt.repartition(partitions(spark), "cell", "part").sortWithinPartitions("cell", "part", "asks", "length", "word")
    found = dealt.mapInArrow(tidy(search), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    got = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return got.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def variants(docs: DataFrame, ratio: int = 5, least_length: int = 6, least_n: int = 5, drop: int = 199, id_col: str = "doc_id",
             text_col: str = "text", sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of ``count_words``.

    The form of a word is its near word of largest n (ties: the first in code-point order) if that n is at least
    ``ratio`` times the word's own, else null; the root is reached by following forms to the last (n grows by the ratio
    each time, so chains are short; each round doubles what has been followed).

    Null texts have no words; a null id counts as an empty one in the hash. Rows that repeat count each time. Texts
    are whole, words of any length. Other columns are ignored; without words the result is empty.
    """
    words = written(count_words(docs, least_length, least_n, drop, id_col, text_col), "words")
    joined = words.join(near_words(words, sample, cell), "word", "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    table = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"),
                                  F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    steps = written(table.filter("form is not null").select("word", F.col("form").alias("to")), "steps")
    while True:
        ahead = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        if steps.join(ahead, "to", "left_semi").isEmpty():
            break
        before, steps = steps, written(steps.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to")), "steps")
        forget(before)
    out = table.join(steps, "word", "left")
    return out.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
