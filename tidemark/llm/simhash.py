"""SimHash near-duplicates found through Golay-code keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a
23-bit word of the perfect binary Golay code (23, 12, 7). Fingerprints that differ in at
most 3 bits have at most one segment with two errors or more, so at least two of the three
segments differ in at most one bit (pigeonhole). Any word lies within 3 bits of exactly one
codeword. Two words one bit apart have different parity; the word of odd weight is keyed by
its own codeword alone and that of even weight by the codewords of itself and of its 23
neighbours (1 to 6 codewords), so words at distance 0 or 1 always share a key. A bucket is
a pair of segments with a pair of 12-bit codeword indices. Buckets are joined by sorting
and every candidate is verified on the full fingerprints. A bucket yields a spanning
forest of its links, never all pairs; a crowded one is split by the remaining segment.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, bound_batches, bounded_slices, component_labels, connected_components, cut, release, shingle_hashes, texts_of, written

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
_GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, the Golay code's generator polynomial
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float64)


def fingerprints(df: DataFrame, text: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``fingerprint`` (long) to ``df``: the SimHash of k-word shingles of ``text``.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A shingle is its words
    joined by one space, repeats counted; with fewer than k words it is the whole sequence. A
    bit is 1 if it is set in over half of the shingles' XXH64 values. Null or wordless texts
    have fingerprint 0. Other columns pass through, whatever their names, but for one called
    ``fingerprint``, which is replaced. A text of any length takes bounded memory besides its own.
    """
    bound_batches(df.sparkSession)
    df = df.drop("fingerprint") if text != "fingerprint" else df
    keep = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*keep)
    own = plain.withColumn("_t", F.col(keep[df.columns.index(text)]))

    def run(batches):
        for batch in batches:
            for part in bounded_slices(batch, "_t"):
                found = _fingerprint(texts_of(part.column("_t")), k, seed)
                rest = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(found.view(np.int64))], names=[*keep, "_f"])

    out = own.mapInArrow(run, plain.schema.add("_f", "long"))
    return out.toDF(*df.columns, "fingerprint")


def _fingerprint(texts: list[bytes], k: int, seed: int) -> np.ndarray:
    n = len(texts)
    ones, total = np.zeros((n, 64)), np.zeros(n, np.int64)
    for doc, hashes in shingle_hashes(texts, k, seed):
        _count_bits(doc, hashes, ones, total)
    return _majority(ones, total)


def _count_bits(doc: np.ndarray, hashes: np.ndarray, ones: np.ndarray, total: np.ndarray) -> None:
    """Adds up, for each text, the hashes that have each bit set, and all its hashes."""
    if not len(doc):
        return
    low = int(doc[0])
    n = int(doc[-1]) - low + 1
    base = (doc - low) * 256
    for j, byte in enumerate(hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T):
        seen = np.bincount(base + byte, minlength=n * 256).reshape(n, 256)
        ones[low : low + n, 8 * j : 8 * j + 8] += seen @ _BYTE_BITS
    total[low : low + n] += np.bincount(doc - low, minlength=n)


def _majority(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each 23-bit unit vector, and the error pattern of each remainder."""
    unit = np.zeros(23, np.int64)
    for i in range(23):
        r = 1 << i
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= _GENERATOR << (bit - 11)
        unit[i] = r
    error = np.full(2048, -1, np.int64)
    error[0] = 0
    for i in range(23):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = (1 << i) | (1 << j)
            for h in range(j):
                error[unit[i] ^ unit[j] ^ unit[h]] = (1 << i) | (1 << j) | (1 << h)
    assert (error >= 0).all()
    return unit, error


def codeword_index(word: np.ndarray) -> np.ndarray:
    """The 12-bit index (leading bits) of the one codeword within 3 bits of each 23-bit word."""
    unit, error = _golay()
    remainder = np.zeros(len(word), np.int64)
    for i in range(23):
        remainder ^= np.where(word >> i & 1, unit[i], 0)
    return (word ^ error[remainder]) >> 11


def segment_keys(word: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of 23-bit words, a row each, -1 where there are fewer than 6.

    ``width``: bits the segment really has; the others are always zero and are never flipped.
    """
    first = codeword_index(word)
    out = np.full((len(word), 6), -1, np.int64)
    out[:, 0] = first
    even = np.flatnonzero(np.bitwise_count(word) % 2 == 0)
    if len(even):
        near = np.stack([first[even], *(codeword_index(word[even] ^ (1 << i)) for i in range(width))], axis=1)
        near.sort(axis=1)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        rows, cols = np.nonzero(fresh)
        nth = np.cumsum(fresh, axis=1)[rows, cols] - 1
        block = np.full((len(even), 6), -1, np.int64)
        block[rows, nth] = near[rows, cols]
        out[even] = block
    return out


def bucket_keys(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every bucket that each fingerprint falls into."""
    parts = [(f >> np.uint64(s)).astype(np.int64) & ((1 << w) - 1) for s, w in SEGMENTS]
    keys = [segment_keys(p, w) for p, (_, w) in zip(parts, SEGMENTS)]
    rows, out = [], []
    for n, (i, j) in enumerate(PAIRS):
        both = (keys[i][:, :, None] << 12) | keys[j][:, None, :]
        ok = (keys[i][:, :, None] >= 0) & (keys[j][:, None, :] >= 0)
        at = np.nonzero(ok)
        rows.append(at[0])
        out.append(both[at] | (n << 24))
    return np.concatenate(rows), np.concatenate(out)


def link_group(f: np.ndarray, distance: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indices) of a spanning forest of the links among distinct fingerprints ``f``.

    Leaders first: each takes all that lie within ``distance`` of it. Then leaders' clusters
    that are near enough to hold a link and are not yet joined are compared. Memory is linear.
    """
    n = len(f)
    root = np.arange(n)
    rest, clusters = np.arange(n), []
    while len(rest):
        near = np.bitwise_count(f[rest] ^ f[rest[0]]) <= distance
        clusters.append(rest[near])
        root[rest[near]] = rest[0]
        rest = rest[~near]
    lead = np.array([c[0] for c in clusters])
    parent = np.arange(len(lead))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    extra_a, extra_b = [], []
    for i in range(len(lead)):
        close = np.flatnonzero(np.bitwise_count(f[lead[i + 1 :]] ^ f[lead[i]]) <= 3 * distance) + i + 1
        for j in close:
            if find(i) == find(j):
                continue
            a, b = clusters[i], clusters[j]
            if len(a) == 1 and len(b) == 1:
                continue  # two leaders alone are farther apart than a link
            for x in a:
                hit = np.flatnonzero(np.bitwise_count(f[b] ^ f[x]) <= distance)
                if len(hit):
                    extra_a.append(x)
                    extra_b.append(b[hit[0]])
                    parent[find(i)] = find(j)
                    break
    member = np.flatnonzero(root != np.arange(n))
    a = np.concatenate([root[member], np.array(extra_a, np.int64)])
    b = np.concatenate([member, np.array(extra_b, np.int64)])
    return a, b


_SMALL = 48


def _links(key: np.ndarray, f: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (fingerprints) of rows sorted by key, whole buckets only."""
    cutp = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(cutp)
    ea, eb = [], []
    for s, m in zip(cutp[:-1][size > _SMALL], size[size > _SMALL]):
        a, b = link_group(f[s : s + m], distance)
        ea.append(f[s + a])
        eb.append(f[s + b])
    small = np.repeat((size > 1) & (size <= _SMALL), size)
    k, g = key[small], f[small]
    for d in range(1, _SMALL):
        same = k[d:] == k[:-d] if d < len(k) else np.zeros(0, bool)
        if not same.any():
            break
        hit = np.flatnonzero(same & (np.bitwise_count(g[d:] ^ g[: len(g) - d]) <= distance))
        ea.append(g[hit])
        eb.append(g[hit + d])
    if not ea:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(ea), np.concatenate(eb)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = component_labels(len(nodes), at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def sub_keys(key: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Four finer keys of each row of a bucket, a row each: a quarter of the segment that the bucket leaves out.

    That segment differs in at most 3 bits between linked fingerprints, so one quarter is equal.
    """
    out = np.empty((len(key), 4), np.int64)
    for n, pair in enumerate(PAIRS):
        at = np.flatnonzero(key >> 24 == n)
        start, width = SEGMENTS[3 - sum(pair)]
        edges = [width * q // 4 for q in range(5)]
        for q in range(4):
            part = (f[at] >> np.uint64(start + edges[q])).astype(np.int64) & ((1 << (edges[q + 1] - edges[q])) - 1)
            out[at, q] = (key[at].astype(np.int64) << 8) | (q << 6) | part
    return out


def near_edges(distinct: DataFrame, distance: int = 3, crowd: int = 4_096) -> DataFrame:
    """Edges (a, b) that span the components of links among a column ``fingerprint`` of distinct longs.

    A bucket of over ``crowd`` fingerprints is not linked in one piece: its rows are dealt again by
    the quarters of the segment that the bucket leaves out, so no link is lost.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the keys cover distances 0 to 3")
    bound_batches(distinct.sparkSession)

    def expand(batches):
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            for s in range(0, len(f), 20_000):
                rows, keys = bucket_keys(f[s : s + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f[s : s + 20_000][rows].view(np.int64))], names=["key", "f"])

    def finer(batches):
        for batch in batches:
            key, f = (batch.column(c).to_numpy() for c in ("key", "a"))
            yield pa.RecordBatch.from_arrays([pa.array(sub_keys(key, f.view(np.uint64)).ravel()), pa.array(np.repeat(f, 4))], names=["key", "f"])

    def scan(most):
        """Rows come sorted by key, and a bucket may span batches. Links (key null), or the rows of buckets of over ``most``."""

        def out(a, b, key=None):
            cols = [pa.array(x.view(np.int64)) for x in (a, b)] + [pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key"])

        def found(k, f, crowded):
            edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            size = np.diff(edges)
            large = np.repeat(size > most, size) | (k == crowded)
            if large.any():
                yield out(f[large], f[large], k[large])
            yield out(*_links(k[~large], f[~large], distance))

        def run(batches):
            held_k, held_f, crowded = np.zeros(0, np.int64), np.zeros(0, np.uint64), -1
            for batch in batches:
                k = np.concatenate([held_k, batch.column(0).to_numpy()])
                f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
                if not len(k):
                    continue
                done = int(np.searchsorted(k, k[-1]))
                if len(k) - done > most:
                    last, done = int(k[-1]), len(k)
                else:
                    last = -1 if k[-1] != crowded else crowded
                if done:
                    yield from found(k[:done], f[:done], crowded)
                held_k, held_f = k[done:], f[done:]
                crowded = last if last >= 0 else crowded
            if len(held_k):
                yield from found(held_k, held_f, crowded)

        return run

    def dealt(rows: DataFrame, most: float) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(scan(most), "a long, b long, key long")

    keys = distinct.select("fingerprint").mapInArrow(expand, "key long, f long")
    first = cut(dealt(keys, crowd))
    links, rest = first.where("key is null").select("a", "b"), first.where("key is not null")
    if rest.limit(1).isEmpty():
        return links
    return links.union(dealt(rest.mapInArrow(finer, "key long, f long"), math.inf).select("a", "b"))


def _shingle_sets(texts: list[bytes], k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash) of every distinct shingle, ascending; the number and the key of each text's set; its fingerprint."""
    docs, all_hashes = [], []
    ones, total = np.zeros((len(texts), 64)), np.zeros(len(texts), np.int64)
    for doc, hashes in shingle_hashes(texts, k, seed):
        _count_bits(doc, hashes, ones, total)
        docs.append(doc)
        all_hashes.append(hashes)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    hashes = np.concatenate(all_hashes) if docs else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[fresh], hashes[fresh]
    n = np.bincount(doc, minlength=len(texts))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes, dtype=np.uint64)])
    ends = np.cumsum(n)
    return doc, hashes, n, sums[ends] - sums[ends - n], _majority(ones, total)


HOT = 64
_SLOTS = 26  # a bitmap of 2^26 bits marks hot shingles: 8 MB, whatever the table
_SENT_ROWS = 400_000


def _prefix(n):
    """Shingles of a set of n of which a similar set must hold one (0.8 n or more are shared)."""
    return n - (4 * n + 4) // 5 + 1


def _hot_shingles(seen: DataFrame) -> np.ndarray:
    """A bitmap of the slots of tokens that ``seen`` holds more than ``HOT`` times: 2^20 words at most come to the driver."""
    hot = seen.groupBy("token").count().where(F.col("count") > HOT).select(F.col("token").bitwiseAND(F.lit((1 << _SLOTS) - 1)).alias("slot"))
    word = hot.groupBy(F.shiftright("slot", 6).cast("int").alias("word"))
    rows = word.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (_SLOTS - 6), np.uint64)
    bitmap[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bitmap


def similar_edges(df: DataFrame, text: str = "text", k: int = 5, seed: int = 42) -> DataFrame:
    """Links (a, b) of fingerprints of texts whose sets of k-word shingles have a Jaccard of 0.8 or more.

    Exact but for 64-bit hashes; thinned, but with the same components. Wordless texts take no part.

    * Shingles are ordered by whether they are hot (in over ``HOT`` sets, as counted over all sets'
      early shingles), then by hash; two similar sets share one among the first n - ceil(0.8 n) + 1
      of each. So a passage that many texts hold only counts where nearly the whole text is such.
    * The sets of a shingle meet if they pass the length and positional filters. A pair's shared
      shingles are counted over all shingles first, and what the rest could still add must reach
      the overlap. The few pairs that stay are verified on their whole sets.
    * In buckets of over ``HOT`` sets each set first meets the least one only, and any set the least
      of its other partners; then only pairs that are not yet in one component are verified.
    """
    spark = df.sparkSession
    bound_batches(spark)
    own = df.select(F.col(text).alias("_t"))

    def parts(batches):
        for batch in batches:
            for part in bounded_slices(batch, "_t"):
                yield _shingle_sets(texts_of(part.column("_t")), k, seed)

    def place(doc, n):
        return np.arange(len(doc)) - (np.cumsum(n) - n)[doc]

    def name(batches):
        for _, _, n, c, f in parts(batches):
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[some].view(np.int64)), pa.array(f[some].view(np.int64))], names=["c", "f"])

    def early(batches):
        for doc, h, n, _, _ in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(h[place(doc, n) < 3 * _prefix(n[doc]) // 2 + 8].view(np.int64))], names=["token"])

    bitmap = spark.sparkContext.broadcast(_hot_shingles(own.mapInArrow(early, "token long")))

    def post(batches):
        bits = bitmap.value
        for doc, h, n, c, _ in parts(batches):
            slot = (h & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)
            hot = (bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            order = np.argsort(2 * doc + hot, kind="stable")
            doc, h, hot = doc[order], h[order], hot[order]
            pos = place(doc, n)
            first = pos < _prefix(n[doc])
            doc, h, hot, pos = doc[first], h[first], hot[first], pos[first]
            own_c = c[doc].view(np.int64)
            cols = [h.view(np.int64), np.where(hot > 0, 1 + own_c % 61, 0).astype(np.int32), own_c, n[doc].astype(np.int32), pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["token", "salt", "c", "n", "pos"])

    def whole(batches):
        for _, h, n, c, _ in parts(batches):
            at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(h.view(np.int64)))], names=["c", "keys"])

    def meet(batches):
        """Rows come sorted by token, salt and set. Pairs of small buckets (token null), rows of large ones (other null)."""
        names = ["token", "salt", "c", "n", "pos"]
        held = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32, np.int32)]

        def batch_of(token, c, n, other, m, pos):
            null = lambda x: np.full(len(c), x is None)
            cols = [pa.array(np.zeros(len(c), np.int64) if x is None else x, t, mask=null(x)) for x, t in zip((token, c, n, other, m, pos), _MET_TYPES)]
            return pa.RecordBatch.from_arrays(cols, names=["token", "c", "n", "other", "m", "pos"])

        def found(token, salt, c, n, pos):
            fresh = np.ones(len(token), bool)  # copies
            fresh[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1])
            token, salt, c, n, pos = (x[fresh] for x in (token, salt, c, n, pos))
            heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(heads, len(token)))
            large = np.repeat((np.maximum.reduceat(salt, heads) > 0) | (size > HOT), size)
            size = np.repeat(size, size)
            yield batch_of(token[large], c[large], n[large], None, None, pos[large])
            small = ~large & (size > 1)
            token, c, n, pos = (x[small] for x in (token, c, n, pos))
            for d in range(1, HOT):
                if d >= len(token) or not (same := np.flatnonzero(token[d:] == token[:-d])).size:
                    break
                a, b = same, same + d
                na, nb, ia, ib = (x.astype(np.int64) for x in (n[a], n[b], pos[a], pos[b]))
                least = 4 * (na + nb)
                near = (9 * np.minimum(na, nb) >= least) & (9 * (np.minimum(ia, ib) + np.minimum(na - ia, nb - ib)) >= least)
                a, b = a[near], b[near]
                yield batch_of(None, c[a], n[a], c[b], n[b], None)

        for batch in batches:
            rows = [np.concatenate([h, batch.column(x).to_numpy()]) for h, x in zip(held, names)]
            token = rows[0]
            if not len(token):
                continue
            done = int(np.searchsorted(token, token[-1]))
            if not done and len(token) > 4 * BATCH_ROWS:  # let a large bucket go; the salt of the row that is held marks the others
                done = len(token) - 1
                rows[1] = np.maximum(rows[1], 1)
            held = [x[done:] for x in rows]
            if done:
                yield from found(*(x[:done] for x in rows))
        if len(held[0]):
            yield from found(*held)

    a, b = (lambda x: F.col(f"a.{x}")), (lambda x: F.col(f"b.{x}"))
    least = 4 * (a("n") + b("n"))
    possible = (9 * F.least(a("n"), b("n")) >= least) & (9 * (F.least(a("pos"), b("pos")) + F.least(a("n") - a("pos"), b("n") - b("pos"))) >= least)

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.distinct())
        if pairs.isEmpty():
            return pairs.toDF("a", "b")
        used = cut(pairs.select("c").union(pairs.select("other")).distinct())
        sent = F.broadcast(used) if used.count() <= _SENT_ROWS else used
        sets = written(own.mapInArrow(whole, "c long, keys array<long>").join(sent, "c").dropDuplicates(["c"]), "shingles")
        both = pairs.join(sets.toDF("c", "kc"), "c").join(sets.toDF("other", "ko"), "other")
        overlap = F.size(F.array_intersect("kc", "ko"))
        links = cut(both.where(9 * overlap >= 4 * (F.size("kc") + F.size("ko"))).select(F.col("c").alias("a"), F.col("other").alias("b")))
        release(sets)
        return links

    named = cut(own.mapInArrow(name, "c long, f long").distinct())
    posts = own.mapInArrow(post, "token long, salt int, c long, n int, pos int")
    met = posts.repartition("token", "salt").sortWithinPartitions("token", "salt", "c").mapInArrow(meet, _MET)
    met = written(met, "met")
    crowd = met.where("other is null").select("token", "c", "n", "pos")
    counted = met.where("token is null").groupBy("c", "other", "n", "m").agg(F.count("*").alias("shared"))
    some = cut(crowd.select("c").distinct()).withColumn("some", F.lit(True))  # sets whose shared shingles are not all counted
    marked = counted.join(some, "c", "left").join(some.toDF("other", "some_too"), "other", "left")
    beyond = F.greatest(F.expr("n - (n - ceil(n * 4 / 5) + 1)"), F.expr("m - (m - ceil(m * 4 / 5) + 1)"))
    enough = 9 * (F.col("shared") + beyond) >= 4 * (F.col("n") + F.col("m"))
    likely = cut(marked.where(enough | F.col("some") | F.col("some_too")).select("c", "other"))
    lead = cut(crowd.groupBy("token").agg(F.min(F.struct("c", "n", "pos")).alias("o")).select("token", "o.*"))
    star = crowd.alias("a").join(lead.alias("b"), "token").where((a("c") != b("c")) & possible)
    nearest = likely.groupBy("other").agg(F.min("c").alias("c"))
    links = similar(star.select(F.least(a("c"), b("c")).alias("c"), F.greatest(a("c"), b("c")).alias("other")).union(nearest.select("c", "other")))
    comps = connected_components(links)

    def labelled(rows: DataFrame, key: str, out: str) -> DataFrame:
        return rows.join(comps.toDF(key, out), key, "left").withColumn(out, F.coalesce(out, key))

    rest = labelled(labelled(likely, "c", "x"), "other", "y").where("x <> y").select("c", "other")
    open_ = labelled(crowd, "c", "x")
    apart = open_.alias("a").join(open_.alias("b"), "token").where((a("c") < b("c")) & (a("x") != b("x")) & possible)
    links = links.union(similar(rest.union(apart.select(a("c").alias("c"), b("c").alias("other")))))
    release(met)
    one = named.groupBy("c").agg(F.min("f").alias("f"))
    equal = named.join(one.withColumnRenamed("f", "a"), "c").select("a", F.col("f").alias("b"))
    far = links.join(one.toDF("a", "fa"), "a").join(one.toDF("b", "fb"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    return cut(equal.union(far).where("a <> b").distinct())


_MET = "token long, c long, n int, other long, m int, pos int"
_MET_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())


def _labelled(df: DataFrame, id_col: str, text: str, k: int, distance: int, similar: bool = False) -> DataFrame:
    """(_id, _k2, fingerprint, component_id), a row for each row; _k2 tells texts of one id apart."""
    own = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_k2"), F.col(text).alias("_text"))
    prints = cut(fingerprints(own, "_text", k).drop("_text"))
    classes = cut(prints.groupBy("fingerprint").agg(F.min("_id").alias("first")))
    edges = near_edges(classes.select("fingerprint"), distance)
    if similar:
        edges = edges.union(similar_edges(df, text, k))
    comps = connected_components(edges).withColumnRenamed("node", "fingerprint")
    joined = classes.join(comps, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = cut(joined.join(least, "component").select("fingerprint", "component_id", "component"))
    return prints.join(labels, "fingerprint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, distance: int = 3) -> DataFrame:
    """(id_col, fingerprint long, component_id): the smallest id among the texts reachable by links.

    Texts with equal fingerprints are one class, so copies cost one row each and no pairs. A
    null id keeps its row and never names a component unless all ids of the component are
    null. Repeated rows stay repeated. An empty table gives an empty result.
    """
    return _labelled(df, id_col, text, k, distance).select(F.col("_id").alias(id_col), "fingerprint", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, distance: int = 3, similar: bool = False) -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row with the least id stays.

    ``similar``: whether a Jaccard of 0.8 or more of the k-word shingles is a link too, at any distance.
    Null ids come last; ties (rows that share the id) go by a hash of the text, and of equal
    rows any one stays.
    """
    found = cut(_labelled(df, id_col, text, k, distance, similar))
    rank = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_k2").alias("k"))
    first = found.groupBy("component").agg(F.min(rank).alias("m"))
    stay = cut(first.select(F.col("m.i").alias("_id"), F.col("m.k").alias("_k2")).distinct())
    repeated = not found.groupBy("_id", "_k2").count().where("count > 1").limit(1).isEmpty()
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    i, t = names[df.columns.index(id_col)], names[df.columns.index(text)]
    sent = F.broadcast(stay) if stay.count() <= _SENT_ROWS else stay
    rows = plain.withColumn("_h", F.xxhash64(t)).join(sent, F.col(i).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k2")))
    if repeated:  # aggregated before the shuffle, however many there are
        rows = rows.groupBy(i, "_h").agg(F.first(F.struct(*names)).alias("_r")).select("_r.*")
    return rows.select(*names).toDF(*df.columns)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
