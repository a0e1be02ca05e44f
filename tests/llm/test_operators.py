"""The ten operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, classifier, lines, neighbours, packing, quality, registry, simhash, suffix, urlfilter, warc
from tidemark.llm.common import Words, connected_components, xxh64_ranges

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


AWKWARD = [None, "", " \n\t ", "one", "one", "two words", "é ñ 漢字 \u2003x", "a b c d e f g\n" * 3, "word " * 3000, "x" * 50_000]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_oracle(compare, name):
    compare(registry.QUERIES[name], registry.ORACLES[name])


# shared kernels


def test_vectorised_hash_equals_the_library():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(4000))
    spans = [(s, s + n) for n in range(100) for s in (rng.randrange(3000),)] + [(0, 4000)]
    got = xxh64_ranges(np.frombuffer(data, np.uint8), np.array([a for a, _ in spans]), np.array([b for _, b in spans]), 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in spans]


def test_words_equal_split():
    texts = [t.encode() for t in ("", " A\x0bb\n\nC ", "É à", "\t", "z")]
    w = Words(texts)
    got = [[bytes(w.buf[s:e]) for d, s, e in zip(w.doc, w.start, w.end) if d == i] for i in range(len(texts))]
    assert got == [t.lower().split() for t in texts]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (-5, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, -5: -5, 200: -5}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


# 1 packing


def test_packing_loses_nothing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 5, 99, 512, 513, 8192, 20_000, rng.randrange(1, 9000)])) for i in range(300)] + [(None, 7), (3, None), (5, -1), (5, 40), (5, 40)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), shard_items=100).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.piece_length
    want = Counter()
    for i, n in rows:
        want[i] += max(0, n or 0)
    assert total == want
    bins: dict = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.piece_length
        assert at == r.bin_used <= r.bin_capacity
        assert r.bin_capacity == min(c for c in packing.CAPACITIES if c >= at)
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).isEmpty()


def brute_best_fit(lengths, sizes, cost):
    """The same rules with plain lists; of equally full bins the one that was touched last is taken."""
    best = None
    for prefer in [None, *sizes]:
        left, room, used, touched = sum(lengths), [], [], []
        for t, n in enumerate(lengths):
            fits = [b for b in range(len(room)) if room[b] >= n]
            if fits:
                b = min(fits, key=lambda b: (room[b], -touched[b]))
            else:
                can = [c for c in sizes if c >= n]
                size = min(can, key=lambda c: (cost(c) / min(c, left), c)) if prefer is None else (prefer if prefer >= n else can[0])
                b = len(room)
                room.append(size)
                used.append(0)
                touched.append(t)
            room[b], used[b], touched[b] = room[b] - n, used[b] + n, t
            left -= n
        total = sum(min(cost(c) for c in sizes if c >= u) for u in used)
        best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_costs_what_brute_force_costs(seed):
    rng, sizes = random.Random(seed), [16, 32, 64]
    lengths = sorted((rng.randrange(1, 65) for _ in range(60)), reverse=True)
    at, final = packing.pack_lengths(lengths, sizes, packing.default_cost)
    assert sum(map(packing.default_cost, final)) == pytest.approx(brute_best_fit(lengths, sizes, packing.default_cost))


# 2 classifier


def test_classifier_orders_held_out_grades(spark):
    rng = random.Random(5)
    common = [f"w{i}" for i in range(200)]
    marks = {0: ["vile", "nasty"], 1: ["$$$", "!!!"], 2: ["fine", "well"]}
    rows = []
    for i in range(900):
        g = i % 3
        rows.append((i, " ".join(rng.sample(common, 30) + [rng.choice(marks[g]) for _ in range(3)]), g))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = classifier.train(df, df.where("doc_id < 600").select("doc_id", "grade"))
    assert (np.diff(model.thresholds) > 0).all()
    got = classifier.score(df.where("doc_id >= 600"), model).collect()
    assert np.mean([(r.kept == (r.grade == 2)) for r in got]) > 0.97
    mean = [np.mean([r.expected_grade for r in got if r.grade == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_classifier_edge_cases(spark):
    df = docs_of(spark, AWKWARD).withColumn("kept", F.lit("clash"))
    none = classifier.score(df, classifier.train(df, classifier.graded(spark.createDataFrame([], "doc_id long, quality int, toxic int"))))
    assert none.count() == len(AWKWARD) and all(r.kept and r.p_top is None for r in none.collect())
    rated = classifier.graded(spark.createDataFrame([(5, 1, 0), (5, 0, 0), (7, 1, 0), (8, 1, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, rated.collect())) == [(5, 1), (7, 2), (8, 0)]
    out = classifier.score(df, classifier.train(df, rated))
    assert out.count() == len(AWKWARD) and out.columns.count("kept") == 1


# 3 WARC


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/\r\nX: y", "p" * 200), (2, None, "p" * 200), (3, "http://c", None), (4, "u", ""), (4, "u", ""), (None, "n", "é" * 9000), (7, "k", "\r\n\r\nWARC/1.1\r\n" * 50), (8, "s", "tiny"), (9, "s", "tiny")],
        "page_id long, url string, html string",
    )
    path = f"file://{tmp_path}/warc"
    warc.write_archive(pages, path, segment_bytes=700)
    found = warc.read_records(spark, path)
    got = warc.read_responses(found).collect()
    assert not [r.error for r in got if r.error]
    assert sorted((r.page_id or 0, bytes(r.payload)) for r in got) == sorted((p.page_id or 0, (p.html or "").encode()) for p in pages.collect() if p.page_id != 2)
    assert [(r.page_id, r.refers_to_page_id) for r in found.where("type = 'revisit'").collect()] == [(2, 1)]
    assert found.where("type = 'continuation'").count() > 20
    empty = f"file://{tmp_path}/none"
    warc.write_archive(pages.limit(0), empty)


def test_broken_segments_are_told():
    whole = [{"segment": 1, "total": None, "block": b"ab"}, {"segment": 2, "total": 3, "block": b"c"}]
    assert warc.reassemble(whole) == (b"abc", 1)
    for bad in (whole[:1], whole[1:], [whole[0], whole[1] | {"total": 9}], [*whole, whole[0] | {"block": b"xx"}], [whole[0], whole[1] | {"segment": 3}]):
        with pytest.raises(ValueError):
            warc.reassemble(bad)
    assert warc.unchunked(b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\nT: v\r\n\r\n") == b"abcde"
    for bad in (b"5\r\nab", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


# 4 URL filters


def test_urls(spark):
    urls = [None, "", "x.com/en/", "http://COM/en/", "http://a.example.com/en/78", "http://xexample.com/en/7", "http://a.example.net/de/80?x=/de/8", "ftp://example.org/es/#q", "http://example.org/es", "a://b.net?/de/", "://com/en/1", "http://.com/en/"]
    got = urlfilter.filter_urls(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")).collect()

    def brute(host, path):
        best = None
        for h, p, v in urlfilter.RULES:
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
                best = (h + p, v)
        return best or (None, "allow")

    for r in got:
        assert (r.rule, r.verdict) == brute(r.host, r.path), r
    assert [(r.host, r.path) for r in got][:4] == [("", "")] * 3 + [("com", "/en/")]
    assert got[4].rule == "example.com/en/7" and got[6].path == "/de/80"
    with pytest.raises(ValueError):
        urlfilter.build_trie(urlfilter.RULES, max_rules=2)


# 5 suffix array


def brute_repeats(texts, length):
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                cover[s] += 1
                cover[s + length] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        out.append((bytes(b for b, g in zip(t, gone) if not g), int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_repeated_starts(seed):
    rng = random.Random(seed)
    source = bytes(rng.choice(b"ab") for _ in range(2500))
    length = rng.choice([64, 100, 150, 401])
    blocks = []
    for _ in range(25):
        s = rng.randrange(1500)
        b = bytearray(source[s : s + length + rng.randrange(300)])
        b[rng.randrange(len(b))] = 99
        blocks.append(bytes(b))
    count = Counter(b[s : s + length] for b in blocks for s in range(len(b) - length + 1))
    got = suffix.repeated_starts(blocks, length, bucket=300)
    assert [g.tolist() for g in got] == [[count[b[s : s + length]] > 1 for s in range(len(b) - length + 1)] for b in blocks]


@pytest.mark.parametrize("crowd", [2, 4096])
def test_repeats_equal_brute_force(spark, crowd):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(40)) + (passage[rng.randrange(50) :] if i % 2 else "") + " ".join(word() for _ in range(20)) for i in range(24)]
    texts += [None, "", "short", "z" * 700, passage, passage, "aé" * 300]
    ids = [*range(len(texts) - 2), None, 3]
    df = docs_of(spark, texts, ids).withColumn("kept", F.lit("clash"))
    got = suffix.remove_repeats(df, length=100, crowd=crowd).select("text", "kept", "removed").collect()
    want = {t: w for t, w in zip(texts, brute_repeats([(t or "").encode() for t in texts], 100))}
    assert len(got) == len(texts)
    assert all((bytes(r.kept), len(r.removed)) == want[r.text] for r in got)
    for r in suffix.remove_repeats(df, length=100, whole_chars=True).collect():
        bytes(r.kept).decode()
    assert suffix.remove_repeats(df.limit(0), length=100).isEmpty()


# 6 neighbours


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[700:] = x[rng.integers(0, 700, 800)] + rng.normal(size=(800, 24)).astype(np.float32) * 0.2
    x[10:60] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2002, [math.nan] * 24), (2003, [1.0]), (None, [1.0] * 24), (2100, [None] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in neighbours.search(df, df.where("vec_id % 100 = 0 or vec_id = 12")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = 0
    y = x.astype(float)
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        assert all(s == d[v] for v, s in found) and found == sorted(found, key=lambda p: (p[1], p[0])) and len(found) == 10
        best = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        hit += len(set(best) & {v for v, _ in found})
    assert set(got) == {*range(0, 1500, 100), 12}
    assert [v for v, _ in got[12]] == [10, 11, *range(13, 21)]
    assert hit / (10 * len(got)) >= 0.9
    few = df.where("vec_id < 3")
    assert neighbours.search(few, few).count() == 6
    assert neighbours.search(df.limit(0), df.limit(0)).isEmpty()


# 7 lines


def brute_lines(rows):
    """Places of removed lines of (order, text) rows."""
    earlier, out = [], []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        gone = []
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            s = set(line.lower().split())
            if len(s) >= lines.MIN_TOKENS:
                if any(9 * len(s & e) >= 4 * (len(s) + len(e)) for e in earlier):
                    gone.append(i)
                earlier.append(s)
        out.append((key, gone))
    return out


@pytest.mark.parametrize("crowd", [2, 256])
def test_lines_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(3, 30))] for _ in range(12)]

    def line():
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        return " ".join(words)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for i in range(60)] + [(90, None), (91, ""), (92, "\n\n"), (None, line())]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.removed_lines) for r in got), key=repr) == sorted(brute_lines(rows), key=repr)
    text = dict(rows)
    for r in got:
        kept = None if text[r.doc_id] is None else "\n".join(s for i, s in enumerate(text[r.doc_id].split("\n")) if i not in r.removed_lines)
        assert r.text == kept


def test_lines_of_repeated_rows(spark):
    t = "one two three four five\nhi"
    got = lines.dedup_lines(spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == ["hi", "hi", "hi", t]
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


# 8 BPE


@pytest.fixture(scope="module")
def tokens():
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_tokens_equal_the_library(tokens):
    path, pattern, own = tokens
    rng = random.Random(8)
    texts = ["", " ", " a  b\n\n c \x1c\x1c d\x85 e", "x" * 3000, "ab" * 400 + " 's it's\n", "é" * 400, "\x1f\x1e  a", "<|endoftext|>", "😀" * 200 + " 12 345", "!" * 700]
    texts += ["".join(rng.choice("ab c\n\t'sédé1  !?") for _ in range(rng.randrange(300))) for _ in range(300)]
    encoder = bpe.Encoder(bpe.read_ranks(path), pattern)
    for _ in range(2):
        assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_encode_and_decode_whole_texts(spark, tokens):
    path, pattern, own = tokens
    df = docs_of(spark, AWKWARD).withColumnRenamed("lang", "_text")
    both = bpe.decode(bpe.encode(df, path, pattern), path).collect()
    assert len(both) == len(AWKWARD)
    for r in both:
        assert r.ids == own.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


# 9 SimHash


def brute_simhash(text, k=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_golay_keys_meet_at_every_distance_up_to_three():
    rng = np.random.default_rng(6)
    f = rng.integers(0, 1 << 63, 400, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
    for d in range(4):
        g = f.copy()
        for i in range(len(f)):
            for bit in rng.choice(64, d, replace=False):
                g[i] ^= np.uint64(1) << np.uint64(bit)
        (ra, ka), (rb, kb) = simhash.bucket_keys(f), simhash.bucket_keys(g)
        a, b = set(zip(ra.tolist(), ka.tolist())), set(zip(rb.tolist(), kb.tolist()))
        assert {r for r, _ in a & b} == set(range(len(f)))


def test_crowded_buckets_keep_their_components():
    rng = np.random.default_rng(2)
    f = np.unique(np.concatenate([np.uint64(c) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for c in (0, 0xFFFF, 0xFF00FF00FF00FF00)]))
    a, b = simhash.link_group(f)
    want = brute_components(f.tolist())
    label = list(range(len(f)))
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = label[x], label[y]
        label = [min(p, q) if v in (p, q) else v for v in label]
    assert label == want and len(a) < len(f)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(12)
    base = [[f"v{rng.randrange(400)}" for _ in range(250)] for _ in range(8)]
    texts = list(AWKWARD)
    for _ in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(250)] = "changed"
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = [brute_simhash(t) for t in texts]
    assert [got[i].fingerprint & (1 << 64) - 1 for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == brute_components(prints)
    one = simhash.keep_one(docs_of(spark, texts), k=3)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(brute_components(prints)))
    assert one.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_of_repeated_and_null_ids_stays(spark):
    df = docs_of(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "other words here now"], [None, 4, 4, None])
    assert sorted(repr(r.doc_id) for r in simhash.keep_one(df).collect()) == ["4", "None"]
    assert simhash.near_duplicates(df.limit(0)).isEmpty()


def test_similar_shingles_link_at_any_distance(spark):
    rng = random.Random(21)
    base = [[f"v{rng.randrange(900)}" for _ in range(rng.randrange(3, 140))] for _ in range(12)]
    texts = list(AWKWARD)
    for _ in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(w))
    prints, sets = [brute_simhash(t, 5) for t in texts], []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    plain, label = brute_components(prints), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= 3
            if near or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    got = simhash.keep_one(docs_of(spark, texts), k=5, similar=True)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(label))
    assert len(set(label)) < len(set(plain))
    assert simhash.keep_one(docs_of(spark, texts).limit(0), similar=True).isEmpty()


# 10 quality rules


def test_statistics(spark):
    def brute(t):
        w, ls = (t or "").split(), [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if x]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        rep = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), sum((t or "").count(c) for c in quality.SYMBOLS), len(ls) - len(set(ls)), len(rep)

    texts = [*AWKWARD, "#*$%&|<> a", "x y z x y z x\nx y z\nx y z", "fff\x0cf f\r\n|", "a a a a a"]
    got = quality.statistics(docs_of(spark, texts).withColumn("n_words", F.lit("clash"))).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in quality.BASE) for r in got] == [brute(t) for t in texts]


def test_cutoffs_follow_exact_binomial_tails(spark):
    def tail(k, n, p):
        return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))

    for k, n, p in ((0, 100, 0.0125), (1, 700, 0.0125), (5, 900, 0.0125), (2, 50, 0.3)):
        got = spark.range(1).select(F.expr(quality._tail(f"{k}L", f"{n}L", p)).alias("t")).first().t
        assert got == pytest.approx(tail(k, n, p) if k <= n * p else 1.0, rel=1e-9)
    few = spark.createDataFrame([(i, "en", 100, 500, 0, 10, 0, 0) for i in range(20)], "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    labels = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.cutoffs(few, labels).isEmpty()
    many = few.select("*", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("e")).withColumn("doc_id", F.col("doc_id") * 100 + F.col("e")).drop("e")
    lots = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    cut = quality.cutoffs(many, lots).first()
    assert cut.cut_symbols == 0.05 and cut.cut_long_words == 7.0


def test_rules_on_awkward_tables(spark):
    df = docs_of(spark, AWKWARD, [None, *range(len(AWKWARD) - 1)])
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.apply_rules(df, labels)
    assert out.count() == len(AWKWARD) and all(r.base_failed and not r.kept for r in out.collect() if r.n_words < 50)
    assert quality.apply_rules(df.limit(0), labels).isEmpty()


# whole queries


@pytest.mark.parametrize("name", ["op1_packing", "op2_classifier", "op5_suffix", "op8_bpe"])
def test_query_covers_every_document(spark, name):
    want = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in registry.QUERIES[name](spark, SF).select("doc_id").collect()} == want


def test_suffix_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.text or "").encode() for r in rows]
    want = {r.doc_id: (len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for r, t, (k, n) in zip(rows, texts, brute_repeats(texts, 400))}
    assert {r[0]: tuple(r[1:]) for r in registry.QUERIES["op5_suffix"](spark, SF).collect()} == want
