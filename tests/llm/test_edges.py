"""Hot groups, long texts, clashing names, ids of other types, and methods against independent ones."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, classifier, common, lines, neighbours, packing, quality, simhash, suffix, urlfilter, warc

from .test_operators import brute_components, brute_lines, brute_repeats, brute_simhash, docs_of


# 1 packing


def test_repeated_and_null_ids_are_dealt_over_shards(spark):
    rows = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(7).cast("long").alias("length"))
    got = packing.pack(rows, shard_items=5_000)
    assert got.count() == 60_000
    per_shard = got.select(F.shiftright("bin_id", 24).alias("s")).groupBy("s").count().collect()
    assert len(per_shard) == 12 and max(r["count"] for r in per_shard) < 6_000
    assert got.groupBy("bin_id").agg(F.sum("piece_length").alias("n"), F.max("bin_used").alias("u")).where("n <> u").isEmpty()


def test_packing_keeps_ids_of_any_type(spark):
    got = packing.pack(spark.createDataFrame([("a", 5, "x"), (None, 9000, "x"), ("a", 5, "x")], "doc_id string, length long, bin_id string")).collect()
    assert Counter((r.doc_id, r.piece_length) for r in got) == {("a", 5): 2, (None, 8192): 1, (None, 808): 1}


# 2 classifier


def test_fit_finds_the_optimum_of_the_same_likelihood():
    rng = np.random.default_rng(1)
    n, d = 120, 4
    x = rng.random((n, d)) * (rng.random((n, d)) < 0.7)
    grade = np.clip((x @ [2.0, -1.0, 0.5, 0.0] + rng.logistic(size=n) * 0.5 + 0.5).round().astype(int), 0, 2)
    row, col = np.nonzero(x)
    model = classifier.fit(row, col, x[row, col], grade, bits=3, steps=400)

    def loss(w, t0, gap):  # written from the definition, one document at a time
        t = [-math.inf, t0, t0 + math.exp(gap), math.inf]
        s = lambda v: 0.0 if v == -math.inf else 1.0 if v == math.inf else 1 / (1 + math.exp(-v))
        total = 0.3 / 2 * sum(v * v for v in w) + 1e-3 * (t0 * t0 + gap * gap)
        for xi, g in zip(x, grade):
            score = sum(a * b for a, b in zip(w, xi))
            total -= math.log(s(t[g + 1] - score) - s(t[g] - score))
        return total

    p = np.zeros(d + 2)
    f = lambda v: loss(v[:d], v[d], v[d + 1])
    for _ in range(60):  # Newton's method with numerical derivatives
        e, h = np.eye(d + 2), 1e-4
        g = np.array([(f(p + h * a) - f(p - h * a)) / (2 * h) for a in e])
        hess = np.array([[(f(p + h * a + h * b) - f(p + h * a - h * b) - f(p - h * a + h * b) + f(p - h * a - h * b)) / (4 * h * h) for a in e] for b in e])
        step = np.linalg.solve(hess + 1e-6 * np.eye(d + 2), g)
        while f(p - step) > f(p) + 1e-12 and np.abs(step).max() > 1e-10:
            step /= 2
        p = p - step
    assert np.allclose(model.weights[:d], p[:d], atol=2e-3)
    assert np.allclose(model.thresholds, [p[d], p[d] + math.exp(p[d + 1])], atol=2e-3)


def test_training_takes_one_text_an_id_whatever_repeats(spark):
    base = [(i, f"{'good fine' if i % 2 else 'vile bad'} w{i % 7}") for i in range(40)]
    rated = spark.createDataFrame([(str(i), 2 * (i % 2)) for i, _ in base], "doc_id string, grade int")
    once = spark.createDataFrame([(str(i), t) for i, t in base], "doc_id string, text string")
    many = once.union(once.where("doc_id = '3'").crossJoin(spark.range(500)).select("doc_id", "text")).union(spark.createDataFrame([("3", "zzz")], once.schema))
    a, b = classifier.train(once, rated), classifier.train(many, rated)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)
    empty = classifier.score(once.limit(0), a)
    assert empty.isEmpty() and empty.columns[-3:] == ["expected_grade", "p_top", "kept"]


# 3 WARC


def test_archive_query_agrees_with_its_sql_on_null_ids(spark, tmp_path):
    import duckdb

    big = "q" * 300
    pages = spark.createDataFrame([(None, "u", big), (5, "u", big), (3, "v", big), (None, "w", "r" * 200), (None, "w", "r" * 200), (9, None, None), (9, "x", "s" * 150), (9, "x", "s" * 150), (None, "y", "tiny")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op3_warc(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))) == sorted(map(repr, con.sql(warc.OP3_SQL).fetchall()))


# 4 URL filters


def test_the_trie_is_bounded_by_its_nodes(spark):
    rules = [(f"h{i}.example.com", "/a/b/", "block") for i in range(50)]
    assert urlfilter.judge(urlfilter.build_trie(rules), "x.h7.example.com", "/a/b/c") == ("h7.example.com/a/b/", "block")
    with pytest.raises(ValueError):
        urlfilter.build_trie(rules, max_nodes=100)
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string")).isEmpty()


# 5 suffix array


def test_a_text_longer_than_every_part(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    long = noise(common.PART_BYTES + 70_000) + passage + noise(3_000)
    texts = [long, noise(500) + passage, "x" * 1000]
    got = {r.doc_id: (bytes(r.kept), len(r.removed)) for r in suffix.remove_repeats(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(3)] == brute_repeats([t.encode() for t in texts], 400)


# 6 neighbours


@pytest.mark.parametrize("kind", ["float", "double"])
def test_every_query_has_all_its_rows(spark, kind):
    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.normal(size=(500, 16)) * 0.01 for c in rng.normal(size=(6, 16))] + [rng.normal(size=(1, 16)) * 1000 + rng.normal(size=(3, 16)) for _ in range(10)])
    x[1] = x[0] + 4e-8
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    asked = df.where("vec_id % 100 = 0 or vec_id >= 3000")
    got: dict = {}
    for r in neighbours.search(df, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert len(got) == 60 and all(len(v) == 10 for v in got.values())
    for q, found in got.items():
        d = np.sqrt(((x[[v for v, _ in found]] - x[q]) ** 2).sum(axis=1))
        assert [s for _, s in found] == d.tolist()
        if q >= 3000:  # the others of its small cluster come first
            assert {v for v, _ in found[:2]} == {v for v in range(3000 + (q - 3000) // 3 * 3, 3003 + (q - 3000) // 3 * 3) if v != q}
    if kind == "double":
        assert got[0][0][0] == 1 and 0 < got[0][0][1] < 1e-6


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table = rows.orderBy("vec_id").toArrow()
    ids, x = table["vec_id"].to_numpy(), neighbours._matrix(table["embedding"])
    got: dict = {}
    for r in neighbours.search(rows, rows.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        d = ((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1)
        hit += len(found & {v for v in ids[np.lexsort((ids, d))[:11]].tolist() if v != q})
    assert len(got) == int((ids % 100 == 0).sum()) and hit / (10 * len(got)) >= 0.9


# 7 lines


def test_a_word_that_thousands_of_lines_share(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["rarest", *(f"w{rng.randrange(4000)}" for _ in range(9))])) for i in range(5_000)]
    near = [(6_000 + i, t + " extra") for i, (_, t) in enumerate(rng.sample(rows, 40))]
    got = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(rows + near, "doc_id long, text string")).where(F.size("removed_lines") > 0).collect()}
    assert got >= {i for i, _ in near} and len(got) <= 45


def test_crowds_of_lines_make_few_rows(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"common{i}" for i in range(30)]

    def line(i):  # any two share 30 of 40 words; every tenth is like the one before
        own = i - 1 if i % 10 == 9 else i
        return " ".join(rng.sample(base, 30) + [f"own{own}x{j}" for j in range(5)])

    rows = [(i, line(i)) for i in range(200)]
    made = []
    for name in ("written", "cut"):
        plain = getattr(lines, name)
        monkeypatch.setattr(lines, name, lambda df, *a, f=plain: (made.append((out := f(df, *a)).count()), out)[1])
    got = sorted((r.doc_id, r.removed_lines) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_lines(rows)) and sum(len(x) for _, x in got) == 20
    assert max(made) <= 20 * len(rows)  # 15 keys a line; all pairs would be 100 a line


def test_only_lines_like_another_are_read_from_a_crowd(spark, monkeypatch):
    base = [f"commonword{i:02d}" for i in range(20)]  # the longest words, so all keys of all prefixes are crowded

    def line(i):  # every tenth has all words but one of the line before, any others half of theirs
        own = [f"o{i - 1 if i % 10 == 9 else i}x{j}" for j in range(20)]
        return " ".join(base + (own[1:] + [f"y{i}"] if i % 10 == 9 else own))

    rows = [(i, line(i)) for i in range(200)]
    read, plain = [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, name, *a: (out := plain(df, name, *a), read.append(out.count()) if name == "sets" else None)[0])
    got = sorted((r.doc_id, r.removed_lines) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_lines(rows)) and sum(len(x) for _, x in got) == 20
    assert len(read) == 2 and max(read) <= 50  # 20 pairs; the crowd has 200 lines


def test_long_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "CROWD", 4)
    rng = random.Random(8)
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([36, 40, 44, 120, 250, 262, 600]))]
        for share in (0, 0.08, 0.11, 0.13, 0.2):  # replaced words, on both sides of the threshold
            rows.append((len(rows), " ".join(w if rng.random() >= share else f"x{rng.randrange(10**6)}" for w in base)))
        rows.append((len(rows), " ".join(base[: len(base) * rng.choice([79, 80, 81]) // 100])))
    got = sorted((r.doc_id, r.removed_lines) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_lines(rows)) and 60 < sum(len(x) for _, x in got) < 240


def test_short_lines_take_part_if_asked(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, "\n".join(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 7))) for _ in range(4))) for i in range(40)]
    monkeypatch.setattr(lines, "MIN_TOKENS", 1)
    want = sorted(brute_lines(rows))
    got = sorted((r.doc_id, r.removed_lines) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_tokens=1).collect())
    assert got == want and sum(len(g) for _, g in got) > 40


def test_lines_of_documents_with_names_for_ids(spark):
    t = "one two three four five\nhi"
    got = lines.dedup_lines(spark.createDataFrame([("a", t, "own"), ("b", t + "\nsix seven eight nine ten", "own")], "doc_id string, text string, c1 string"))
    assert got.columns == ["doc_id", "text", "c1", "removed_lines"] and sum(len(r.removed_lines) for r in got.collect()) == 1


# 8 BPE


def test_very_long_pieces_and_texts_equal_the_library():
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(9)
    unbroken = "".join(rng.choice("abcdeé") for _ in range(30_000))
    long = " ".join("".join(rng.choice("abcdé,.1 \n") for _ in range(rng.randrange(12))) for _ in range(200_000))
    encoder = bpe.Encoder(bpe.read_ranks(path), P.PATTERN)
    assert len(long) > bpe._LONG
    for text in (unbroken, long):
        assert np.frombuffer(encoder.encode([text])[0], "<i4").tolist() == own.encode_ordinary(text)


def test_one_piece_takes_bounded_memory():
    import tracemalloc

    P = pytest.importorskip("public_tokenizers")
    merger = bpe.Merger(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    merger.encode([b"x" * 300])
    piece = b"ab" * 500_000
    tracemalloc.start()
    ids = merger.encode([piece])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) > 100_000 and most < 90 * len(piece)


def test_unknown_ids_are_errors():
    joined, start, size = bpe._table({b"a": 0, b"bc": 2})
    import pyarrow as pa

    got = bpe._decoded(pa.array([[2, 0], [], None], pa.list_(pa.int32())), joined, start, size)
    assert got.to_pylist() == [b"bca", b"", b""]
    for bad in ([1], [3], [-1]):
        with pytest.raises(ValueError):
            bpe._decoded(pa.array([bad], pa.list_(pa.int32())), joined, start, size)


# 9 SimHash


@pytest.mark.parametrize("k", [3, 5])
def test_fingerprint_of_a_text_longer_than_a_part(monkeypatch, k):
    rng = random.Random(k)
    texts = [" \n".join(rng.choice(("a", "bb", "ccc" * 5, "É")) for _ in range(n)) for n in (0, 1, 2, 4, 700)] + ["y" * 3000, "y" * 2000 + " z", " " * 5000 + "q r s t u v"]
    want = [brute_simhash(t, k) for t in texts]
    for limit in (64, 500, 1 << 19):
        monkeypatch.setattr(common, "PART_BYTES", limit)
        monkeypatch.setattr(common.overlapping, "__defaults__", (limit,))
        assert simhash._fingerprint([t.encode() for t in texts], k, 42).tolist() == want


def test_crowded_buckets_are_split_without_losing_links(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64).view(np.uint64)
    f = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for b in base]))
    table = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fingerprint long")

    def components(crowd):
        edges = [(r.a, r.b) for r in simhash.near_edges(table, crowd=crowd).collect()]
        at = {x: i for i, x in enumerate(f.view(np.int64).tolist())}
        return common.component_labels(len(f), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges])).tolist()

    assert components(3) == components(4_096) == brute_components(f.tolist())


# 10 quality rules


def test_false_rejections_stay_within_the_risk(spark):
    rng, strata, n = np.random.default_rng(10), 24, 400
    # the chance that a good text's share of symbols is above a cutoff grows as the cutoff falls: 1, 3, 6, 12 %
    cut = [0.5, 0.2, 0.1, 0.05]
    beyond = [0.01, 0.03, 0.06, 0.12]
    u = rng.random((strata, n))
    symbols = np.select([u < b for b in beyond], [100, 30, 15, 8], 0)
    rows = [(s * n + i, f"s{s}", 100, 500, int(symbols[s, i]), 10, 0, 0) for s in range(strata) for i in range(n)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    labels = spark.range(strata * n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    found = {r.lang: r for r in quality.cutoffs(stats, labels).collect()}
    risk = dict(zip(cut, beyond))
    assert all(risk.get(r.cut_symbols, 0.0) <= quality.RISK for r in found.values())
    assert sum(r.cut_symbols is not None and r.cut_symbols < 1 for r in found.values()) > strata // 2


def test_cutoffs_pass_where_eighty_six_good_texts_lose_none(spark):
    stats = spark.createDataFrame([(i, "en" if i < 86 else "de", 100, 500, 0, 10, 0, 0) for i in range(171)] + [(500, "fr", 100, 500, 0, 10, 0, 0), (501, "es", 100, 500, 0, 10, 0, 0)], "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    labels = stats.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert [r.lang for r in quality.cutoffs(stats, labels).collect()] == ["en"]


# what all share


def test_operators_keep_empty_tables_empty(spark):
    none = docs_of(spark, []).withColumn("removed", F.lit(1)).withColumn("fingerprint", F.lit(1))
    assert lines.dedup_lines(none).isEmpty() and suffix.remove_repeats(none).isEmpty()
    assert simhash.fingerprints(none).isEmpty() and simhash.keep_one(none, similar=True).isEmpty()
    assert packing.pack_documents(none).isEmpty()
    assert simhash.fingerprints(docs_of(spark, ["a"]).withColumn("fingerprint", F.lit(1))).columns.count("fingerprint") == 1


def test_no_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: None)

    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        assert common.shared_dir(Session()) == spark.sparkContext._jsc.sc().getCheckpointDir().get()
    else:
        with pytest.raises(RuntimeError):
            common.shared_dir(Session())


def test_sha_of_parts_is_that_of_the_whole():
    text = " ".join(f"w{i}" for i in range(5_000)).encode()
    parts = list(common.overlapping(text, 1, 1000))
    assert len(parts) > 20 and hashlib.sha256(b"".join(parts)).digest() == hashlib.sha256(text).digest()
