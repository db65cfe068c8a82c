"""Operators on texts against the libraries' plain answers and brute force."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_rows import SF, TEXTS
from eventimpact.llm import bpe, common, language, near_texts, packing, quality, queries, rans

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain(path, text, end):
    return np.array(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={t: r for r, t in enumerate(bpe.read_ranks(MULTI))})


def test_every_token_is_reached_by_the_serialised_model():
    c = bpe.codec(MULTI, public_tokenizers.PATTERN)
    tokens = bpe.read_ranks(MULTI)
    got = c.model.encode([t.decode("latin-1").translate(c.to_letters) for t in tokens])
    assert got == [[r + 1] for r in range(len(tokens))]


def test_chunked_encoding_of_all_code_points():
    """Every tenth block of code points, alone, between spaces and doubled spaces, against the libraries."""
    strings = []
    for k in range(0, 0x110000, 400):
        s = [chr(i) for i in range(k, k + 40) if not 0xD800 <= i < 0xE000]
        strings += ["".join(s), " ".join(s), "a" + " a".join(s), "  ".join(s), "." + "a.".join(s), "\n".join(s), ".a" + " .a".join(s)]
    strings += ["IT'S it's.It's", "a.…b", "x'.'s", ".\n.", "a\n\nb\n c \nd", "é.é\u0301.e", "don't!don'T", "<|endoftext|>.a b<|startoftext|>c",
                "#tag,a-b_c(d)[e]{f}~g`h^i", "ǅ.ß.ÿ/İ.i", "1.a2,b3", "a.'s", "..'ll", "a\r\nb", "x" * 300 + " " + "y" * 299, "×a÷b.×", "a×.÷b"]
    ref, c = reference(), bpe.codec(MULTI, public_tokenizers.PATTERN)
    for s, ids in zip(strings, c.encode(pa.array(strings))):
        assert ids == np.array(ref.encode_ordinary(s), "<u4").tobytes()
        assert c.decode(ids) == s.encode()
    from eventimpact.llm.chunks import cut_ids, library_coder
    from eventimpact.llm.common import utf8
    for path in (BYTES, WORDS):
        t = Tokenizer.from_file(path)
        want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(strings, add_special_tokens=False)]
        assert cut_ids(*library_coder(path)(*utf8(pa.array(strings)))) == want


def test_bpe_round_trip(spark, odd, empty):
    ref = reference()
    got = bpe.round_trip(odd, MULTI, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "text", "lang", "source", "SCORE", "Offset", "ids", "decoded"]
    for r in got.collect():
        assert r.decoded == (r.text or "").encode()
        assert r.ids == np.array(ref.encode_ordinary(r.text or ""), "<u4").tobytes()
    alone = bpe.decode(bpe.encode(odd, MULTI, public_tokenizers.PATTERN, out="t"), MULTI, public_tokenizers.PATTERN, "t")
    assert all(r.decoded == (r.text or "").encode() for r in alone.collect())
    assert bpe.round_trip(empty, MULTI, public_tokenizers.PATTERN).count() == 0


def test_op2_on_the_given_documents(spark):
    ref = reference()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op2_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(ref.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def brute_bins(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in {rooms[j]: j for j in range(len(rooms)) if rooms[j] >= items[i]}.values():
            rooms[j] -= items[i]
            place(i + 1, rooms)
            rooms[j] += items[i]
        place(i + 1, rooms + [capacity - items[i]])
    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = np.random.default_rng(0)
    for _ in range(80):
        items = rng.integers(1, 31, rng.integers(1, 11)).tolist()
        count = collections.Counter(items)
        plan = packing.complete_bins(count, 30)
        used = collections.Counter()
        for p in plan:
            assert sum(n * k for n, k in p.items) <= 30
            for n, k in p.items:
                used[n] += k * p.times
        best = brute_bins(items, 30)
        assert used == count and packing.lower_bound(count, 30) <= best == sum(p.times for p in plan)
    assert packing.complete_bins({}, 30) == []


def test_shares_of_a_bin_never_exceed_it():
    """Dual feasible: whatever fits one bin has shares of at most one; so the bound holds for every packing."""
    rng = np.random.default_rng(51)
    for _ in range(400):
        capacity, room, total = int(rng.integers(5, 60)), 0, []
        room = capacity
        while room:
            x = int(rng.integers(1, room + 1))
            total.append(x)
            room -= x
        for k in packing.FRACTIONS:
            assert sum(packing.fraction(x, capacity, k) for x in total) <= k * (k + 1)
    thirds = {s: 5 for s in range(600, 720)}                            # three of them never fit: the total says 194
    assert packing.lower_bound(collections.Counter({700: 300}), 2048) == 150
    assert packing.lower_bound(collections.Counter(thirds), 2048) == sum(p.times for p in packing.complete_bins(thirds, 2048))


def test_dominance_of_fillings():
    assert packing.dominates([10, 7], [6, 4, 7]) and packing.dominates([10], [10]) and packing.dominates([5, 5], [])
    assert not packing.dominates([6, 6], [7, 5]) and not packing.dominates([9], [5, 5])
    rng = np.random.default_rng(52)
    for _ in range(300):
        a, b = rng.integers(1, 9, rng.integers(1, 4)).tolist(), rng.integers(1, 9, rng.integers(1, 5)).tolist()
        plain = any(all(sum(x for x, j in zip(b, deal) if j == i) <= a[i] for i in range(len(a)))
                    for deal in itertools.product(range(len(a)), repeat=len(b)))
        assert packing.dominates(a, b) == plain


def test_bin_completion_tries_every_undominated_filling():
    search = packing._Search({1000: 2, 698: 2, 350: 3, 349: 4}, 2048, 4, False)
    got = {tuple(sorted(b[0])) for b in search.branches() if b}
    assert got >= {(350, 698), (1000,)} and (349, 349, 350) not in got              # dealt to 698 and 350
    assert all(f is None or any(packing.dominates(list(g), f) for g in got) for f in search.maximal())
    rng = np.random.default_rng(8)
    for _ in range(60):
        search = packing._Search(collections.Counter(rng.integers(3, 21, 7).tolist()), 30, 4, False)
        top = search.sizes[-1]
        items = sorted((collections.Counter(search.count) - collections.Counter([top])).elements())
        want = set()
        for m in range(1 << len(items)):
            inside = [x for i, x in enumerate(items) if m >> i & 1]
            room = 30 - top - sum(inside)
            if 0 <= room and all(x > room for i, x in enumerate(items) if not m >> i & 1):
                want.add(tuple(inside))
        assert {tuple(sorted(f)) for f in search.maximal() if f is not None} == want


def check_packing(rows, want, capacity):
    docs = collections.defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
    assert set(docs) == set(want)
    for k, v in docs.items():
        v.sort(key=lambda r: (r.piece, r.sequence_id))
        at = 0
        if len({r.piece for r in v}) != len(v):          # repeated rows: each packed once
            v = v[::2]
        for i, r in enumerate(v):
            assert (r.piece, r.start) == (i, at) and (i == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(want[k][at:at + r.length].tobytes())
            at += r.length
        assert at == len(want[k]) and (len(v) == 1 or at > capacity)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= capacity
    return len(sequences)


def test_packing_odd_documents(odd, empty):
    rows = packing.pack_documents(odd, BYTES, 256).collect()
    check_packing(rows, {i: plain(BYTES, t, 0) for i, t in TEXTS}, 256)
    assert packing.pack_documents(empty, BYTES).count() == 0


def test_packing_splits_a_hot_length(spark):
    p = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 700).otherwise(
        F.col("id") % 900 + 1).cast("long").alias("length"))
    rows = packing.pack(p, 2048, ["doc_id", "piece"], group=100).collect()
    total = sum(r.length for r in rows)
    seq = collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for s in seq.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= 2048
    assert len(rows) == 5000 and len(seq) <= -(-total // 2048) + 2


def test_op3_on_the_given_documents(spark):
    texts = {r.doc_id: plain(BYTES, r.text, 0) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_packing(spark, SF).collect()
    n = check_packing(rows, texts, 2048)
    assert n <= -(-sum(map(len, texts.values())) // 2048) + 1


def test_rans_blocks_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    for ids in (np.array([5], "<u4"), np.full(40_000, 7, "<u4"), rng.integers(0, 49_408, 60_000).astype("<u4"),
                rng.zipf(1.3, 100_000).clip(0, 49_407).astype("<u4")):
        lengths = np.array([len(ids) // 3, 0, len(ids) - len(ids) // 3])
        path = tmp_path / "x.rans"
        path.write_bytes(rans.encode_file([4, None, 9], lengths, ids))
        f = rans.TokenFile(f"file://{path}")
        assert (f.ids(0, len(ids)) == ids).all()
        lo, hi = len(ids) // 4, len(ids) // 2
        assert (f.ids(lo, hi) == ids[lo:hi]).all() and f.known.tolist() == [1, 0, 1]
        raw = bytearray(path.read_bytes())
        raw[20] ^= 1
        path.write_bytes(raw)
        with pytest.raises(ValueError):
            rans.TokenFile(f"file://{path}").ids(0, len(ids))


def check_tokens(rows, texts):
    at = 0
    for r, (_, t) in zip(sorted(rows, key=lambda r: r.start), sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))):
        ids = plain(WORDS, t, 1)
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids.tobytes())
        at += len(ids)
    assert len(rows) == len(texts)


def test_token_files(spark, odd, empty, tmp_path):
    m = rans.write_tokens(odd, f"file://{tmp_path}/a", WORDS, ids_per_file=1000)
    check_tokens(rans.read_tokens(m, span=500).collect(), TEXTS)
    assert rans.read_tokens(rans.write_tokens(empty, f"file://{tmp_path}/b", WORDS)).count() == 0


def test_op5_on_the_given_documents(spark):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = {r.doc_id: r for r in queries.op5_tokens(spark, SF).collect()}
    at = 0
    for k, t in texts:
        ids = plain(WORDS, t, 1)
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def slow_bits(grams, text, lang, order):
    """Partial matching written out: for every byte the longest context first, escapes added on the way down."""
    data, total = b"\n" * order + text.encode(), 0.0
    for t in range(order, len(data)):
        cost, done = 0.0, False
        for k in range(order, -1, -1):
            followers = grams[lang].get(data[t - k:t])
            if not followers:
                continue
            n, d = sum(followers.values()), len(followers)
            if data[t] in followers:
                cost, done = cost - np.log2(followers[data[t]] / (n + d)), True
                break
            cost -= np.log2(d / (n + d))
        total += cost + (0 if done else 8.0)
    return total


def test_code_lengths_equal_the_plain_recursion():
    train = {"xx": ["abracadabra abra", "cadabra"], "yy": ["ich dich sich", "dichter nebel"]}
    order, grams, rows = 3, {}, collections.Counter()
    for i, (name, texts) in enumerate(train.items()):
        grams[name] = collections.defaultdict(collections.Counter)
        for s in texts:
            data = b"\n" * order + s.encode()
            for t in range(order, len(data)):
                rows[(i, int.from_bytes(data[t - order:t + 1], "big"))] += 1
                for k in range(order + 1):
                    grams[name][data[t - k:t]][data[t]] += 1
    lang, path, n = (np.array(x) for x in zip(*[(i, p, c) for (i, p), c in rows.items()]))
    m = language.build(list(train), lang, path.astype(np.uint64), n.astype(float), order)
    texts = ["abra nebel", "zzz", "", "dich\ncad"]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = m.code_lengths(data, off)
    want = [[slow_bits(grams, t, name, order) for name in train] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)


def test_language_cases(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = language.train(docs)
    got = {(r.doc_id, r.text): r for r in language.detect(odd, m, score_out="score").collect()}
    assert len(got) == len(TEXTS) - 1
    for (_, t), r in got.items():
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in m.langs and 0 <= r.score <= 1
    assert got[(6, TEXTS[5][1])].lang_pred == "fr" == got[(7, TEXTS[6][1])].lang_pred
    assert language.detect(empty, m).count() == 0
    blank = language.train(empty)
    assert {r.lang_pred for r in language.detect(odd, blank).collect()} == {"und"}


def test_language_and_posterior_equal_plain_prediction(spark):
    """Training counts, prediction and posterior against plain Python over all rows of a small table."""
    rng = np.random.default_rng(31)
    letters = {"aa": "abcdeé ", "bb": "abcfgh ", "cc": "cdxyzß "}
    rows = [(i, "".join(rng.choice(list(letters[g]), int(rng.integers(1, 60)))), g) for i, g in enumerate(rng.choice(list(letters), 90))]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "123 4", "cc"), (203, "abc abc", None)]
    df = spark.createDataFrame([(i, t, None if g is None else str(g)) for i, t, g in rows], "doc_id long, text string, lang string")
    order, grams = 3, {}
    for _, t, g in rows:
        if t and g is not None:
            own = grams.setdefault(str(g), collections.defaultdict(collections.Counter))
            data = b"\n" * order + t.encode()
            for at in range(order, len(data)):
                for k in range(order + 1):
                    own[data[at - k:at]][data[at]] += 1
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.detect(df, language.train(df)).collect()}
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert got[i] == ("und", 0.0)
            continue
        bits = {g: slow_bits(grams, t, g, order) for g in sorted(grams)}
        best = min(bits, key=bits.get)
        assert got[i][0] == best
        assert abs(got[i][1] - 1 / sum(2.0 ** (bits[best] - b) for b in bits.values())) < 1e-3


def test_sparse_children_find_what_was_put_in():
    rng = np.random.default_rng(32)
    up, symbol = np.divmod(rng.choice(40_000 * 60, 70_000, replace=False), 60)
    table = language.Children.of(60, up, symbol)
    assert (table.find(up, symbol) == np.arange(70_000)).all()
    known = set(zip(up.tolist(), symbol.tolist()))
    other = [(a, b) for a, b in zip(rng.integers(0, 50_000, 5000).tolist(), rng.integers(0, 60, 5000).tolist()) if (a, b) not in known]
    assert (table.find(*(np.array(x) for x in zip(*other))) == 70_000).all()


def test_op6_held_out_accuracy(spark):
    got = queries.op6_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    held = got.filter("held_out")
    assert held.filter("lang_pred = lang").count() >= 0.97 * held.count() > 0


def test_quality_cases(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(quality.sample_labels(docs, labels))
    rows = quality.score(odd, m).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    bias = 1 / (1 + np.exp(-m.bias))
    assert all(abs(r.score - bias) < 1e-9 for r in rows if not r.text)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert quality.score(empty, m).count() == 0
    nothing = quality.train(quality.sample_labels(empty, labels))
    assert {r.score for r in quality.score(odd, nothing).collect()} == {0.5}


MASK64 = (1 << 64) - 1


def slow_mix(x):
    x = ((x ^ (x >> 30)) * int(common._M1)) & MASK64
    x = ((x ^ (x >> 27)) * int(common._M2)) & MASK64
    return x ^ (x >> 31)


def slow_features(text, buckets):
    """Buckets of words, repeated words and byte n-grams of one text, by plain loops."""
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    out, last = [], None
    for w in re.split(rb"[\x00-\x20]+", b):
        if w:
            total = 0
            for k, c in enumerate(w):
                v = (int(common.BYTE_VALUE[c]) * int(common.PLACE[k & 63])) & MASK64
                total += ((v ^ (v >> 29)) * int(common._M1)) & MASK64
            h = slow_mix(total & MASK64)
            out.append(h % buckets)
            if h == last:
                out.append(slow_mix(quality.AGAIN) % buckets)
            last = h
    for g in quality.NGRAMS:
        out += [slow_mix(int.from_bytes(b[i:i + g], "big") + (g << 40)) % buckets for i in range(len(b) - g + 1)]
    return out


def test_quality_score_equals_the_plain_mean(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(quality.sample_labels(docs, labels))
    some = docs.select("doc_id", "text").filter("doc_id % 9 = 0 and length(text) < 5000").unionAll(odd.filter("length(text) < 5000").select("doc_id", "text"))
    rows = quality.score(some, m).collect()
    assert len(rows) > 80
    for r in rows:
        ids = slow_features(r.text, len(m.weight))
        logit = sum(float(m.weight[i]) for i in ids) / max(len(ids), 1) + m.bias
        assert abs(r.score - 1 / (1 + math.exp(-logit))) < 1e-6


def test_quality_descent_equals_plain_steps():
    """The batch step against loops over single numbers."""
    rng = np.random.default_rng(41)
    rows = []
    for k in range(30):
        ids = np.sort(rng.choice(12, 4, replace=False)).astype(np.int32)
        rows.append((int(ids[0] < 3), ids, np.full(4, 0.25, np.float32)))
    got = quality.fit(rows, 12, 3, 4, 1.0, 5, batch=8)
    draw = np.random.default_rng(5)
    emb = [[float(x) for x in r] for r in draw.uniform(-1, 1, (12, 3)).astype(np.float32) / 3]
    out, bias, done = [[0.0, 0.0] for _ in range(3)], [0.0, 0.0], 0
    for _ in range(4):
        order = draw.permutation(30)
        for lo in range(0, 30, 8):
            part = [rows[i] for i in order[lo:lo + 8]]
            step = 1.0 * (1 - done / 120)
            done += len(part)
            means = [[sum(float(s) * emb[i][d] for i, s in zip(ids, share)) for d in range(3)] for _, ids, share in part]
            errors = []
            for (y, _, _), mean in zip(part, means):
                z = [sum(mean[d] * out[d][c] for d in range(3)) + bias[c] for c in (0, 1)]
                e = [math.exp(v - max(z)) for v in z]
                errors.append([e[c] / sum(e) - (c == y) for c in (0, 1)])
            back = [[sum(p[c] * out[d][c] for c in (0, 1)) for d in range(3)] for p in errors]
            for d in range(3):
                for c in (0, 1):
                    out[d][c] -= max(-1.0, min(1.0, step * sum(m[d] * p[c] for m, p in zip(means, errors))))
            for c in (0, 1):
                bias[c] -= 0.1 * step * sum(p[c] for p in errors) / len(part)
            for (_, ids, share), g in zip(part, back):
                for i, s in zip(ids, share):
                    for d in range(3):
                        emb[i][d] -= step * float(s) * g[d]
    want = [sum(emb[i][d] * (out[d][1] - out[d][0]) for d in range(3)) for i in range(12)]
    assert np.allclose(got.weight, want, atol=1e-3) and abs(got.bias - (bias[1] - bias[0])) < 1e-4


def test_contradicting_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, quality.sample_labels(docs, labels).collect())) == [("b", 1), ("c", 0)]


def test_op1_held_out_accuracy(spark):
    got = queries.op1_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    held = got.filter("held_out")
    assert held.filter("predicted = quality").count() >= 0.93 * held.count() > 0


def slow_bag(t):
    w = "".join(c.lower() if c < "\x80" else c for c in t or "").split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def slow_classes(rows, least=0.8):
    bags = [slow_bag(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a
    holders = collections.defaultdict(list)
    for i, b in enumerate(bags):
        for k in b:
            holders[k].append(i)
    both = collections.Counter()
    for k, at in holders.items():
        for x in range(len(at)):
            for y in range(x):
                both[at[y], at[x]] += min(bags[at[x]][k], bags[at[y]][k])
    for (a, b), n in both.items():
        if n / (sum(bags[a].values()) + sum(bags[b].values()) - n) >= least and find(a) != find(b):
            top[find(a)] = find(b)
    least_id = {}
    for i, (k, _) in enumerate(rows):
        least_id[find(i)] = min(least_id.get(find(i), k), k)
    return {k: least_id[find(i)] for i, (k, _) in enumerate(rows)}


def test_near_classes_on_the_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in queries.op10_near_texts(spark, "/root/testdata/sf0.01").collect()}
    want = slow_classes(rows)
    assert got == want and any(k != v for k, v in want.items())


def test_near_classes_in_a_large_group(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(300):
        w = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 5)):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(f"z{k}_{i}" for i in range(40))) for k in range(50)] + [(2000, "w1 " * 400), (2001, "w1 " * 420), (2002, "w1 " * 40)]
    got = {r.doc_id: r.class_id for r in near_texts.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_classes(rows) and got[2001] == 2000 and got[2002] == 2002


def test_missing_finds_every_pair_that_no_centre_took(spark):
    """Texts around one centre, edited by replacing, deleting, inserting and trimming: each near pair that the star
    does not put into one class is among the pairs to verify, and they are few."""
    rng = np.random.default_rng(9)
    c = ["w%d" % i for i in range(120)]
    texts = {0: " ".join(c)}
    for k in range(1, 140):
        w, kind = list(c), int(rng.integers(0, 4))
        for _ in range(int(rng.integers(1, 9))):
            at = int(rng.integers(0, len(w)))
            if kind == 0:
                w[at] = "x%d" % rng.integers(0, 10**6)
            elif kind == 1:
                del w[at]
            elif kind == 2:
                w.insert(at, "y%d" % rng.integers(0, 3))
        if kind == 3:
            lo = int(rng.integers(0, 30))
            w = w[lo:lo + int(rng.integers(60, 120))] + w[:int(rng.integers(1, 12))]
        texts[k] = " ".join(w)
    bags = {k: slow_bag(t) for k, t in texts.items()}
    size = {k: sum(b.values()) for k, b in bags.items()}

    def near(a, b):
        n = sum((bags[a] & bags[b]).values())
        return n / (size[a] + size[b] - n) >= 0.8
    name = lambda k: k.to_bytes(2, "big")
    star = [(name(0), name(k), near(0, k), True) for k in texts if k]
    classes = [(name(k), name(0)) for k in texts if k == 0 or near(0, k)]
    judged = spark.createDataFrame([(a, b, size[int.from_bytes(b, "big")], c, d) for a, b, c, d in star], "c binary, node binary, weight long, near boolean, last boolean")
    got = near_texts.missing(judged, spark.createDataFrame(classes, "node binary, component binary"),
                             spark.createDataFrame([(name(k), t) for k, t in texts.items()], "node binary, text string"), 0.8)
    found = {(int.from_bytes(r.node, "big"), int.from_bytes(r.c, "big")) for r in got.collect()}
    loose = [k for k in texts if k and not near(0, k)]
    want = {(min(a, b), max(a, b)) for a in loose for b in texts if b and a != b and near(a, b)}
    assert len(loose) > 30 and len(want) > 20 and want <= found
    assert len(found) < 0.25 * len(loose) * len(texts)


def test_rows_that_repeat_an_id_are_one_document(spark):
    a, b = " ".join("a%d" % i for i in range(60)), " ".join("b%d" % i for i in range(60))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, "quite another text of a few words"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.kept) for r in near_texts.near_classes(df).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "1", False), ("4", "4", True), ("None", "None", True)]
    kept = sorted((r.doc_id, r.text) for r in near_texts.one_of_each(df).collect())
    assert kept == sorted([(1, a), (1, b), (4, rows[4][1])])                # two texts of one id are not near


def test_one_of_each_keeps_one_row_a_class(spark, odd, empty):
    a = " ".join("a%d" % i for i in range(60))
    rows = [(5, a, "x"), (5, a, "y"), (5, a, "y"), (None, a + " q", "x"), (9, None, "x"), (9, None, "x"), (7, "", "x"), (None, "alone here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    one = near_texts.one_of_each(df).collect()
    assert sorted(map(str, [(r.doc_id, r.text) for r in one])) == sorted(map(str, [(5, a), (9, None), (9, None), (7, ""), (None, "alone here")]))
    assert one == near_texts.one_of_each(df.repartition(3)).collect() or sorted(map(str, one)) == sorted(map(str, near_texts.one_of_each(df.repartition(3)).collect()))
    assert near_texts.one_of_each(odd).columns == odd.columns and near_texts.one_of_each(empty).count() == 0


def test_two_large_groups_in_one_bucket_and_their_links(spark):
    """A centre takes one group, the next centre the other; links between the groups are found."""
    rng = np.random.default_rng(21)
    c = ["w%d" % i for i in range(140)]
    d = c[:118] + ["v%d" % i for i in range(22)]                               # about 0.7 of c
    rows = []
    for k in range(260):
        w = list(c if k % 2 else d)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 140))] = "x%d" % rng.integers(0, 40)
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in near_texts.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_classes(rows)


def test_near_classes_of_trimmed_copies_around_longer_centres(spark):
    rng, rows = np.random.default_rng(5), []
    for g in range(12):
        c = ["g%dw%d" % (g, i) for i in range(124)]
        rows += [(100 * g + 90 + k, " ".join(c + ["c%d" % k] * (k > 0))) for k in range(3)]
        for k in range(20):
            lo, n = int(rng.integers(0, 25)), int(rng.integers(90, 105))
            rows.append((100 * g + k, " ".join(c[lo:lo + n] + ["g%do%d" % (g, i) for i in range(int(rng.integers(0, 6)))])))
    got = {r["doc_id"]: r["class_id"] for r in near_texts.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_classes(rows)


def test_near_classes_cases(odd, empty):
    got = {(r.doc_id, r.class_id, r.kept) for r in near_texts.near_classes(odd).collect()}
    assert {(7, 6, False), (12, 11, False), (2, 2, True), (3, 3, True), (4, 4, True), (None, None, True), (1, 1, True)} <= got
    assert len(got) == len(TEXTS) - 1
    assert near_texts.near_classes(empty).count() == 0


def test_signatures_estimate_weighted_similarity():
    """The share of equal components is the weighted Jaccard similarity, for weights far apart too."""
    rng = np.random.default_rng(5)
    for trial in range(20):
        n = 60
        s = rng.integers(1, 1 << 48, n).astype(np.uint64)
        a, b = rng.integers(0, 20, n), rng.integers(0, 20, n)
        real = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        both = [near_texts.signatures(s[w > 0], np.zeros((w > 0).sum(), np.int64), w[w > 0], 1)[0] for w in (a, b)]
        trial_error = (both[0] == both[1]).mean() - real
        assert abs(trial_error) < 4.5 * np.sqrt(real * (1 - real) / near_texts.SIZE)
