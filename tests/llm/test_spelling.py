"""Spelling variants against plain loops."""

import re
import zlib
from collections import Counter

import numpy as np

from eventimpact.llm import spelling


def plain(rows, least_n=5):
    seen = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 6 and n >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    form, count = {}, {}
    for w, n in words.items():
        others = [o for o in words if abs(len(o) - len(w)) < 2 and near(w, o)]
        count[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, count[w], words[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, Word string, N int")
    got = spelling.variants(df, **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in got.collect())


def test_equals_plain_loops(spark):
    rng = np.random.default_rng(11)
    stems = ["".join(rng.choice(list("aeinrstéñ"), rng.integers(5, 11))) for _ in range(60)]
    rows = []
    for i in range(700):
        words = []
        for _ in range(60):
            w = stems[int(len(stems) * rng.random() ** 3)]
            kind, at = rng.random(), int(rng.integers(0, len(w)))
            if kind < 0.1:
                w = w[:at] + w[at + 1:]
            elif kind < 0.2:
                w = w[:at] + str(rng.choice(list("aeinrst"))) + w[at + 1:]
            elif kind < 0.3:
                w = w[:at] + str(rng.choice(list("aeinrst"))) + w[at:]
            words.append(w.capitalize() if kind > 0.95 else w)
        rows.append((i, " ".join(words)))
    rows.append((None, "chaining " * 900 + "chainin " * 150 + "chaini " * 25 + "chbini " * 5))
    want = plain(rows)
    assert len(want) > 300 and sum(r[1] is not None for r in want) > 100 and any(r[2] != r[1] for r in want if r[1])
    assert run(spark, rows) == want
    assert run(spark, rows, sample=97, cell=16) == want              # many cells, most of them not sampled


def test_odd_rows(spark):
    long = "a" * 30_000
    rows = [(1, None), (2, ""), (None, "letter letter letter letters letters"), (3, "letter LETTER letters letters letters lettre"),
            (3, "lettre lettre lettre lettre"), (4, "123 !!! × x"), (5, "ÀÉÍÓÚÜ " * 6), (6, "àéíóúü " * 6)]
    rows += [(10 + i, f"{long} {long}b") for i in range(5)] + [(20 + i, "tie-words: aaaaaa aaaaab aaaaac " * 1) for i in range(6)]
    rows += [(30 + i, "aaaaad aaaaad aaaaad aaaaad aaaaad aaaaae aaaaae aaaaae aaaaae aaaaae") for i in range(6)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "short")]) == []


def test_anagrams_are_dealt_to_parts(spark):
    """Words of equal letter counts cannot be cut by letters: the cell is dealt to several tasks."""
    rng = np.random.default_rng(12)
    words = sorted({"".join(rng.permutation(list("abcdefg"))) for _ in range(1500)})
    rows = [(i, " ".join(words)) for i in range(5)]
    rows.append((9, " ".join(words[:300] * 30)))
    trees = spelling.upper_trees(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), 400, 32)
    assert max(max(split) for _, _, split in trees.values()) > 5
    assert run(spark, rows, sample=400, cell=32) == plain(rows)


def test_partners_are_within_reach():
    """Every cell that holds a near word is visited."""
    rng = np.random.default_rng(13)
    words = sorted({"".join(rng.choice(list("abcde"), 7)) for _ in range(4000)})
    counts = spelling.letter_counts(*spelling.code_points(words))
    leaves = []
    tree = spelling.build(counts, 40, leaves)
    home = {int(i): leaf for leaf, at in enumerate(leaves) for i in at}
    seen = {(leaf, int(i)) for leaf, at in spelling.reach(tree, counts, 1, 1) for i in at}
    points = spelling.code_points(words)[0].reshape(-1, 7)
    for i in range(0, len(words), 37):
        for j in np.flatnonzero((points != points[i]).sum(1) == 1):
            assert (home[int(j)], i) in seen
    assert len(seen) < 0.7 * len(leaves) * len(words)
