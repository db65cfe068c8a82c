"""Sharding, archives, vector links, top-k and the pipeline against brute force."""

import base64
import collections
import hashlib

import numpy as np
from pyspark.sql import functions as F

from llm_rows import SF, TEXTS
from eventimpact.llm import near_vectors, queries, sharding, topk, warc


def test_permutation_is_a_bijection_with_an_inverse(spark):
    for n in (1, 2, 3, 5, 24, 1000, 4099):
        rows = spark.range(n).select("id", sharding.permute(F.col("id"), n, 9).alias("p"))
        rows = rows.select("id", "p", sharding.permute(F.col("p"), n, 9, inverse=True).alias("back")).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    big = (1 << 40) + 12_345
    rows = spark.range(1000).select((F.col("id") * 1_099_511 + 7).alias("x")).select("x", sharding.permute(F.col("x"), big).alias("p"))
    rows = rows.select("x", "p", sharding.permute(F.col("p"), big, inverse=True).alias("back")).collect()
    assert all(0 <= r.p < big and r.back == r.x for r in rows)


def check_shards(rows, n, shards):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_cases(spark, odd, empty):
    rows = sharding.shard_rows(odd, ["doc_id", "text"], 4).collect()
    check_shards(rows, len(TEXTS), 4)
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str(x) for x in TEXTS)
    again = sharding.shard_rows(odd.repartition(7), ["doc_id", "text"], 4).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard_rows(empty, ["doc_id", "text"], 4).count() == 0
    hot = spark.range(3).withColumn("shard", F.lit("clash")).unionAll(
        spark.range(70_000).select(F.lit(1).cast("long").alias("id"), F.lit("clash").alias("shard")))
    check_shards(sharding.shard_rows(hot, ["id", "shard"], 24).collect(), 70_003, 24)


def test_op4_is_computable_from_the_row_number(spark):
    got = queries.op4_sharding(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = got.collect()
    check_shards(rows, len(docs), 24)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[d.doc_id].size == len(d.text.encode()) + 8 for d in docs)
    number = {d.doc_id: i for i, d in enumerate(sorted(docs, key=lambda d: d.doc_id))}
    asked = spark.createDataFrame(list(number.items()), "doc_id long, n long").select(
        "doc_id", *[c.alias(a) for c, a in zip(sharding.place(F.col("n"), len(docs), 24), ("shard", "slot"))])
    assert {(r.doc_id, r.shard, r.slot) for r in asked.collect()} == {(r.doc_id, r.shard, r.slot) for r in rows}


PAGES = [(5, "http://a", "<p>one</p>"), (3, "http://b", "<p>one</p>"), (9, None, None), (8, "u", ""), (4, "x\r\nX-Bad: 1", "é" * 2_000_000),
         (None, "n", "<p>one</p>"), (3, "http://b", "<p>one</p>"), (11, "v", "\r\n\r\nWARC/1.1\r\n"), (None, "m", "only without ids")]


def want_archive(pages):
    groups = collections.defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    out = []
    for i, _, h in pages:
        ids = [x for x in groups[h or ""] if x is not None]
        first = min(ids) if ids else None
        b, again = (h or "").encode(), first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, "revisit" if again else "response", len(b), digest, first if again else None))
    return sorted(map(str, out))


def test_archive_round_trip_and_random_access(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash", b"x") for p in PAGES], "page_id long, url string, html string, record_type string, payload binary")
    index = warc.write_archive(warc.classify(pages), f"file://{tmp_path}/w")
    got = warc.read_archive(index).collect()
    assert sorted(str((r.id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to)) for r in got) == want_archive(PAGES)
    bodies = {r.id: bytes(r.payload) for r in got if r.record_type == "response" and r.id is not None}
    assert bodies[4] == ("é" * 2_000_000).encode() and bodies[11] == b"\r\n\r\nWARC/1.1\r\n"
    for r in index.filter("id is not null").collect():
        fields, block = warc.Bundle(r.bundle).record(r.frame, r.offset)
        assert fields["X-Page-ID"] == str(r.id) and (fields["WARC-Type"] == "revisit" or block == bodies[r.id])
    none = warc.write_archive(warc.classify(pages.limit(0)), f"file://{tmp_path}/e")
    assert warc.read_archive(none).count() == 0


def test_op7_on_the_given_pages(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = queries.op7_warc(spark, SF).collect()
    assert sorted(str((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to)) for r in got) == want_archive(pages)


def slow_links(ids, x, labels, least=0.93):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    root = np.array(ids)
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], 1 << 60).min(1))
        if (new == root).all():
            return {i: (int(n), int(r)) for i, n, r in zip(ids, linked.sum(1), root)}
        root = new


def test_vector_links_with_clusters_copies_and_chains(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    monkeypatch.setattr(near_vectors, "FAN", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 12))
    x = centres[rng.integers(0, 40, 900)] + 0.12 * rng.normal(size=(900, 12)) * rng.random((900, 1))
    x[100:200] = x[100]
    turn = np.linspace(0, np.pi / 2, 60)
    x[200:260] = 0
    x[200:260, 0], x[200:260, 1] = np.cos(turn), np.sin(turn)
    x = x.astype(np.float32).astype(np.float64)
    labels = rng.integers(0, 3, 900)
    labels[100:260] = 1
    ids = rng.permutation(900)
    df = spark.createDataFrame([(int(i), v.tolist(), int(n)) for i, v, n in zip(ids, x, labels)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.link_components(df).collect()}
    want = slow_links(ids.tolist(), x, labels)
    assert got == want and max(n for n, _ in want.values()) >= 99


def test_vector_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1),
            (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [], 1), (13, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id long, embedding array<double>, label int, n_links int, kept boolean")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.link_components(df).collect()]
    want = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, None)] + [(1, 2, 1, True), (2, 2, 1, False), (13, 2, 1, False)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert near_vectors.link_components(df.limit(0)).count() == 0


def slow_top(rows, k=20, every=20):
    out = {}
    for i, q in rows:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out[i] = [(j, -n) for n, j in s]
    return out


def check_top(got, want):
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(by[r.query_id])
    assert dict(by) == {k: v for k, v in want.items() if v}


def test_top_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "ASKED", 8)
    monkeypatch.setattr(topk, "PIVOTS", 6)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8, 10))[rng.integers(0, 8, 700)] + 0.1 * rng.normal(size=(700, 10))
    x[300:400] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check_top(topk.top_products(df).collect(), slow_top([(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows]))


def test_top_products_of_clustered_unit_vectors(spark):
    """Queries and their own rows fall into the same annuli, which hold far more than k vectors."""
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(0, 60, 4800)] + 0.2 * rng.normal(size=(4800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:1040] = x[1000]                                            # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    z = np.floor(64 * x).astype(np.int64)
    s = z[::20] @ z.T
    want = {}
    for a in range(240):
        order = [j for j in np.lexsort((np.arange(4800), -s[a])) if j != 20 * a][:20]
        want[20 * a] = [(int(j), int(s[a, j])) for j in order]
    check_top(topk.top_products(df).collect(), want)


def test_top_products_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "ASKED", 4)
    monkeypatch.setattr(topk, "TILE", 2)
    rng = np.random.default_rng(18)
    x = rng.normal(size=(900, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    check_top(topk.top_products(df, 7, 10).collect(), slow_top([(i, [int(np.floor(64 * c)) for c in v]) for i, v in enumerate(x)], 7, 10))


def test_top_product_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 1.0]), (20, [0.0, 0.0]), (40, [nan, 1.0]), (60, None), (80, [1.0, None]), (100, [1.0, 1.0, 1.0]), (3, [-1.0, 5.0]), (4, [2.0, 1e9]),
            (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, rank int")
    fine = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows if i in (0, 20, 100, 3, 4)]
    check_top(topk.top_products(df).collect(), slow_top(fine))
    assert topk.top_products(df.limit(0)).count() == 0


def test_op8_and_op9_on_the_given_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    ids, labels = [r.vec_id for r in rows], np.array([r.label for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op8_vectors(spark, SF).collect()}
    assert got == slow_links(ids, x, labels)
    z = np.floor(64 * x).astype(int)
    check_top(queries.op9_topk(spark, SF).collect(), slow_top([(i, v.tolist()) for i, v in zip(ids, z)]))


def test_pipeline_stages_and_result(spark):
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "quality", "near_duplicates", "packing"]
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 456", "en", "s", 7)], docs.schema)
    first = P.language(spark, docs.unionAll(odd), sf)
    assert first.columns == docs.columns and first.count() == docs.count()
    second = P.quality(spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert second.columns == docs.columns
    assert second.join(labels.filter("quality = 1"), "doc_id").count() >= 0.99 * labels.filter("quality = 1").count()
    assert second.join(labels.filter("quality = 0"), "doc_id").count() <= 0.2 * labels.filter("quality = 0").count()
    third = P.near_duplicates(spark, docs, sf)
    from test_texts import slow_classes
    want = set(slow_classes([(r.doc_id, r.text) for r in docs.collect()]).values())
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == want
    packed = P.run(spark, sf)
    rows = packed.collect()
    assert {r.doc_id for r in rows} <= want | {r.doc_id for r in docs.collect()} and len(rows) > 500
    assert max(r.offset + r.length for r in rows) <= 2048
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
