"""Removal of long repeats, by a suffix array built bucket by bucket with a difference cover.

Every byte covered by a ``length``-byte string that also starts elsewhere is removed; matches
never cross texts and are judged on the input.

1. *Blocks.* The anchor of a ``length``-byte string is its k-gram of least hash (the leftmost of
   equals). It depends on the string's content alone, so equal strings have equal anchors at equal
   offsets, and consecutive starts with one anchor form a block. Only an anchor that two blocks
   share can hold a repeat, so the suffixes of all other blocks need no sorting. Blocks of equal
   bytes (a 128-bit hash) are one class, counted before the shuffle, so copies cost one row each.
2. *Suffix array.* One block of each class goes, with all classes of its anchor, to one task, which
   takes anchors in turn, a bounded amount of text at a time. In that text the positions of a
   difference cover modulo 7 ({0, 1, 3}: any two residues have a common shift into it) are the
   samples; they are ranked by doubling. Suffixes are then sorted one bucket of leading bytes at a
   time: by their first 32 bytes, and where these tie, by the precomputed ranks of the samples at
   the common shift, so no tie costs more than a few look-ups and memory is that of one bucket.
   Starts whose suffixes agree to ``length`` bytes are repeats.
3. *Crowded anchors.* An anchor with more than ``crowd`` classes (a passage that very many texts
   embed) would be an unbounded group. Its starts are told apart one by one instead: a 128-bit
   hash of each string, counted with map-side aggregation. No start is dropped or capped.
4. *Cutting.* Runs of repeated starts are sent back to their texts and cut out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, bounded_slices, cut, release, texts_of, written

LENGTH = 400
CROWD = 4_096
CHUNK = 1 << 18  # bytes of text whose blocks are found at once
SORTED = 1 << 19  # bytes of blocks that are sorted at once, unless one anchor has more
COVER = (0, 1, 3)
PERIOD = 7
_FACTOR = 0x9E3779B97F4A7C15
_SHIFT = [[next(d for d in range(7) if (r + d) % 7 in COVER and (s + d) % 7 in COVER) for s in range(7)] for r in range(7)]
_NTH = np.array([0, 1, 0, 2, 0, 0, 0])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _FACTOR, np.uint64), np.full(n, pow(_FACTOR, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Blocks:
    """Blocks of starts that share an anchor."""

    def __init__(self, length: int):
        self.length, self.gram = length, min(64, length // 2)
        self.up, self.down = _powers(2 * CHUNK + 2 * length)

    def _grams(self, buf: np.ndarray) -> np.ndarray:
        n, k = len(buf), self.gram
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(buf * self.up[:n], out=run[1:])
        h = (run[k:] - run[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def find(self, texts: list[bytes]):
        """Yields (text, offset of the first start, starts, anchor hash, block bytes) columns."""
        pieces, size = [], 0
        for i, t in enumerate(texts):
            for s in range(0, max(0, len(t) - self.length + 1), CHUNK):
                part = t[s : s + CHUNK + self.length - 1]
                if pieces and size + len(part) > CHUNK:
                    yield self._find(pieces)
                    pieces, size = [], 0
                pieces.append((i, s, part))
                size += len(part)
        if pieces:
            yield self._find(pieces)

    def _find(self, pieces):
        whole = b"".join(p for _, _, p in pieces)
        buf = np.frombuffer(whole, np.uint8)
        ends = np.cumsum([len(p) for _, _, p in pieces])
        hashes = self._grams(buf)
        width = self.length - self.gram + 1
        key = (hashes >> np.uint64(31) << np.uint64(31)) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(buf) - self.length + 1
        least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
        anchor = (least & np.uint64((1 << 31) - 1)).astype(np.int64)
        inside = np.zeros(n + 1, np.int8)
        first = ends - np.array([len(p) for _, _, p in pieces])
        inside[first] += 1
        inside[ends - self.length + 1] -= 1
        starts = np.flatnonzero(np.cumsum(inside[:n]) > 0)
        a = anchor[starts]
        heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        low = starts[heads]
        count = np.diff(np.append(heads, len(starts)))
        piece = np.searchsorted(ends, low, side="right")
        text = np.array([i for i, _, _ in pieces])[piece]
        offset = low - first[piece] + np.array([s for _, s, _ in pieces])[piece]
        view = memoryview(whole)
        span = count + self.length - 1
        digest = b"".join([xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(low.tolist(), (low + span).tolist())])
        classes = np.frombuffer(digest, "<i8").reshape(-1, 2)
        return text, offset, count, hashes[a[heads]].view(np.int64), classes[:, 0], classes[:, 1]


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 0 of values below 2**44, equals sharing one."""
    n = len(key)
    bits = max(1, (n - 1).bit_length())
    if n and bits + int(key.max()).bit_length() <= 63:
        packed = (key << bits) | np.arange(n)
        packed.sort()
        order, value = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(key, kind="stable")
        value = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])) if n else 0
    return rank


class Words:
    """The eight bytes from any position on, as a big-endian number; gathered, so nothing is held for the others."""

    def __init__(self, buf: np.ndarray):
        self.view = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.view[at].astype(np.uint64)


def _sample_ranks(words: Words, n: int, depth: int) -> np.ndarray:
    """Rank of the ``depth`` bytes at every position of the cover, by doubling; index = 3 * (p // 7) + nth."""
    groups = -(-n // PERIOD)
    at = (np.arange(groups)[:, None] * PERIOD + np.array(COVER)).ravel()
    key = words[at] >> np.uint64(8)  # seven bytes
    order = np.argsort(key)
    rank = np.empty(len(at), np.int64)
    value = key[order]
    rank[order] = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]]))
    d = PERIOD
    while d < depth:
        step = min(d, depth - d)
        ahead = np.zeros_like(rank)
        k = 3 * (step // PERIOD)
        ahead[:-k] = rank[k:]
        rank = _dense(rank * (int(rank.max()) + 1) + ahead)
        d += step
    return rank


def repeated_starts(blocks: list[bytes], length: int = LENGTH, bucket: int = 1 << 17) -> list[np.ndarray]:
    """For each block, a mask of its starts whose ``length`` bytes also start elsewhere in the blocks.

    A block of b bytes has b - length + 1 starts. Suffixes are sorted one bucket at a time.
    """
    if length < 64:
        raise ValueError("length must be 64 or more")
    size = np.array([len(b) for b in blocks])
    n = int(size.sum())
    base = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(blocks) + b"\0" * (length + 16), np.uint8)
    words = Words(buf)
    depth = (length - PERIOD + 1) // PERIOD * PERIOD
    rank = _sample_ranks(words, n, depth)
    many = size - length + 1
    starts = (np.arange(int(many.sum())) + np.repeat(base - (np.cumsum(many) - many), many)).astype(np.uint32)
    found = np.zeros(n, bool)
    lead = (words[starts] >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(lead, kind="stable")
    starts, lead = starts[order], lead[order]
    edges = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
    edges = np.append(edges, len(starts))
    i = 0
    while i < len(edges) - 1:
        j = i + 1
        while j < len(edges) - 1 and edges[j + 1] - edges[i] <= bucket:
            j += 1
        _bucket(starts[edges[i] : edges[j]], words, rank, length, depth, found)
        i = j
    return [found[s : s + m] for s, m in zip(base.tolist(), many.tolist())]


def _bucket(pos: np.ndarray, words: Words, rank: np.ndarray, length: int, depth: int, found: np.ndarray) -> None:
    """Sorts the suffixes of one bucket and marks those that agree with another to ``length`` bytes."""
    pos = pos.astype(np.int64)
    group = np.zeros(len(pos), np.int64)
    for w in range(0, 32, 8):
        word = words[pos + w]
        order = np.lexsort((word, group)) if w else np.argsort(word)
        pos, word, group = pos[order], word[order], group[order]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (group[1:] != group[:-1])])
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1
        pos, group = pos[tied], group[tied]
        if not len(pos):
            return
    # long ties: the rest of the string lies in the cover ranks at a common shift and the last bytes
    ends = _dense_words(words[pos + depth], words[pos + length - 8]) if length - depth > 8 else _dense_words(words[pos + length - 8])
    group = _dense(group * (int(ends.max()) + 1) + ends)
    top = int(rank.max()) + 1
    residue = pos % PERIOD
    lists = [np.flatnonzero(residue == r) for r in range(PERIOD)]

    def key(at, shift):
        p = pos[at] + shift
        return group[at] * top + rank[3 * (p // PERIOD) + _NTH[p % PERIOD]]

    for r in range(PERIOD):
        if not len(lists[r]):
            continue
        own = key(lists[r], _SHIFT[r][r])
        order = np.argsort(own)
        value = own[order]
        same = value[1:] == value[:-1]
        hit = np.zeros(len(own), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        found[pos[lists[r][hit]]] = True
        for s in range(r + 1, PERIOD):
            if not len(lists[s]):
                continue
            a, b = key(lists[r], _SHIFT[r][s]), key(lists[s], _SHIFT[r][s])
            both = np.intersect1d(a, b)
            if len(both):
                for at, k in ((lists[r], a), (lists[s], b)):
                    near = np.minimum(np.searchsorted(both, k), len(both) - 1)
                    found[pos[at[both[near] == k]]] = True


def _dense_words(*words: np.ndarray) -> np.ndarray:
    order = np.lexsort(words[::-1]) if len(words) > 1 else np.argsort(words[0])
    new = np.zeros(len(order), bool)
    for w in words:
        new[1:] |= w[order][1:] != w[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _runs(mask: np.ndarray) -> list[int]:
    """[first, last, first, last, ...] of the mask's runs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def _keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows with (k1, k2), a key that only rows of equal id and text share."""
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k1"),
        F.xxhash64(F.coalesce(text, F.lit("")), F.col(id_col).isNull()).alias("k2"),
        F.col(text).cast("binary").alias("text"),
    )


def find_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(k1, k2, runs): the runs of repeated starts of each text that has any; runs are [lo, first, last, ...] lists."""
    bound_batches(df.sparkSession)
    docs = _keyed(df, id_col, text)

    def blocks(batches):
        finder = Blocks(length)
        for whole in batches:
            for batch in bounded_slices(whole, "text"):
                k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
                for at, lo, n, anchor, c1, c2 in finder.find(texts_of(batch.column("text"))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (anchor, c1, c2, k1[at], k2[at], lo.astype(np.int32), n.astype(np.int32))],
                        names=["anchor", "c1", "c2", "k1", "k2", "lo", "n"],
                    )

    names = ["anchor", "c1", "c2"]
    blocks_of = written(docs.mapInArrow(blocks, "anchor long, c1 long, c2 long, k1 long, k2 long, lo int, n int"), "blocks")
    # most anchors are alone: only their count is shuffled, and only blocks of the others go on
    twice = written(blocks_of.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    light = written(blocks_of.join(twice, "anchor"), "shared")
    release(blocks_of, twice)
    classes = light.groupBy(*names).agg(F.count("*").alias("members"), F.min(F.struct("k1", "k2", "lo", "n")).alias("m"))
    classes = written(classes.select(*names, (F.col("members") > 1).alias("copied"), "m.*"), "kinds")
    kinds = written(classes.groupBy("anchor").agg(F.count("*").alias("kinds")), "counts")
    cand = written(classes.join(kinds, "anchor"), "classes")
    release(classes, kinds)
    # one block of each class, of the anchors that have several
    wanted = (
        cand.where("kinds > 1")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("anchor", "c1", "c2", "copied", "kinds", "lo", "n")).alias("items"))
    )
    parts = (
        docs.join(wanted, ["k1", "k2"])
        .select("text", F.explode("items").alias("i"))
        .selectExpr("i.anchor", "i.c1", "i.c2", "i.copied", "i.kinds", f"substring(text, i.lo + 1, i.n + {length - 1}) as block")
    )
    parts = written(parts, "parts", "lz4")

    def sort_suffixes(batches):
        """Rows come sorted by anchor; an anchor's blocks stay together, texts are bounded."""
        held, size = {}, 0

        def flush(rows):
            out = []
            for (anchor, c1, c2), mask in zip(rows, repeated_starts([b for b, _ in rows.values()], length)):
                if not rows[anchor, c1, c2][1] and mask.any():
                    out.append((anchor, c1, c2, _runs(mask)))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["anchor", "c1", "c2", "runs"])

        last = None
        for batch in batches:
            for anchor, c1, c2, copied, block in zip(*(batch.column(c).to_pylist() for c in ("anchor", "c1", "c2", "copied", "block"))):
                if anchor != last and size > SORTED:
                    yield flush(held)
                    held, size = {}, 0
                last = anchor
                if (anchor, c1, c2) not in held:
                    held[anchor, c1, c2] = (block, copied)
                    size += len(block)
        if held:
            yield flush(held)

    calm = parts.where(F.col("kinds") <= crowd).repartition("anchor").sortWithinPartitions("anchor", "c1", "c2")
    sorted_runs = calm.mapInArrow(sort_suffixes, "anchor long, c1 long, c2 long, runs array<int>")

    def single(batches):
        for batch in batches:
            for anchor, c1, c2, block in zip(*(batch.column(c).to_pylist() for c in ("anchor", "c1", "c2", "block"))):
                view, n = memoryview(block), len(block) - length + 1
                h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[s : s + length]) for s in range(n)]), "<i8").reshape(-1, 2)
                same = (pa.array(np.full(n, x, np.int64)) for x in (anchor, c1, c2))
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["anchor", "c1", "c2", "at", "h1", "h2"]
                )

    each = parts.where(F.col("kinds") > crowd).dropDuplicates(["anchor", "c1", "c2"]).mapInArrow(single, "anchor long, c1 long, c2 long, at int, h1 long, h2 long")
    twice = each.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    crowded = (
        each.join(twice, ["anchor", "h1", "h2"])
        .groupBy("anchor", "c1", "c2")
        .agg(F.flatten(F.collect_list(F.array("at", "at"))).alias("runs"))
    )
    copied = cand.where("copied").select("anchor", "c1", "c2", F.array(F.lit(0), F.col("n") - 1).alias("runs"))
    fresh = sorted_runs.unionByName(crowded).join(cand.where("copied").select("anchor", "c1", "c2"), ["anchor", "c1", "c2"], "left_anti")
    marks = copied.unionByName(fresh)
    found = cut(
        light.join(marks, ["anchor", "c1", "c2"])
        .select("k1", "k2", F.transform("runs", lambda r: r + F.col("lo")).alias("runs"))
        .groupBy("k1", "k2")
        .agg(F.flatten(F.collect_list("runs")).alias("runs"))
    )
    release(light, cand, parts)
    return found


def _cover(runs: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal removed byte ranges of runs of starts."""
    pairs = np.array(runs, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    start, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + length)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[new], end[np.append(new[1:] - 1, len(end) - 1)]


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, crowd: int = CROWD, whole_chars: bool = False
) -> DataFrame:
    """Adds ``kept`` (binary: the remaining bytes) and ``removed`` (array of (start, end) byte ranges) to ``df``.

    Null and empty texts, and texts shorter than ``length``, lose nothing; a null text is kept as
    no bytes. Rows that repeat an id and a text are different texts, so they remove each other.
    Null ids are kept apart from all others. ``whole_chars`` keeps every UTF-8 character that a
    range would cut in two.
    """
    found = find_repeats(df, id_col, text, length, crowd)
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    t, i = names[df.columns.index(text)], names[df.columns.index(id_col)]
    keys = _keyed(plain, i, t)
    k1, k2 = (F.coalesce(F.col(i).cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(t, F.lit("")), F.col(i).isNull()))
    assert keys.columns[:2] == ["k1", "k2"]
    joined = plain.withColumns({"k1": k1, "k2": k2}).join(found, ["k1", "k2"], "left").select(*names, F.col(t).cast("binary").alias("_t"), "runs")

    def run(batches):
        for whole in batches:
            for batch in bounded_slices(whole, "_t"):
                kept, removed = [], []
                for data, runs in zip(texts_of(batch.column("_t")), batch.column("runs").to_pylist()):
                    if not runs:
                        kept.append(data)
                        removed.append([])
                        continue
                    start, end = _cover(runs, length)
                    spans = list(zip(start.tolist(), end.tolist()))
                    if whole_chars:
                        spans = [_inward(data, s, e) for s, e in spans]
                    at, rest = 0, []
                    for s, e in spans:
                        rest.append(data[at:s])
                        at = e
                    kept.append(b"".join([*rest, data[at:]]))
                    removed.append([{"start": s, "end": e} for s, e in spans])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(kept, pa.binary()), pa.array(removed, kind)], names=[*names, "_kept", "_removed"]
                )

    schema = plain.schema.add("_kept", "binary").add("_removed", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    old = [c for c in df.columns if c not in ("kept", "removed")]  # replaced
    out = joined.mapInArrow(run, schema)
    picked = [F.col(names[df.columns.index(c)]).alias(c) for c in old]
    return out.select(*picked, F.col("_kept").alias("kept"), F.col("_removed").alias("removed"))


def _inward(data: bytes, s: int, e: int) -> tuple[int, int]:
    """The range without the parts of characters that it cuts."""
    while s < e and data[s] & 0xC0 == 0x80:
        s += 1
    while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
        e -= 1
    return s, e


def op5_suffix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return remove_repeats(docs).select(
        "doc_id",
        n.alias("n_bytes"),
        (n - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
