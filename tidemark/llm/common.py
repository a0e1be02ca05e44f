"""Shared helpers: durable cuts of lineage, connected components, byte-level NumPy kernels."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of every word pattern used here.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = re.compile(rb"[^\x09-\x0d\x20]+")
BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20
#: Bytes of text that a kernel's arrays are made for at once, and rows.
PART_BYTES = 1 << 19
PART_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local master; on a cluster, whose executors
    would each write to a disk of their own, it is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def bound_batches(spark: SparkSession) -> None:
    """From now on no Arrow batch of this session is over ``BATCH_ROWS`` rows or, by much, ``BATCH_BYTES`` bytes.

    Smaller settings stay as they are. Without this, 10,000 long texts are one batch, held by the
    JVM and by its Python worker.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def number(df: DataFrame, id_col: str, null: int) -> Column:
    """The ids as longs: integers as they are, others by a hash (so of two that collide, one text is enough to tell them apart); null ids as ``null``."""
    own = F.col(f"`{id_col}`")
    kind = dict(df.dtypes)[id_col]
    return F.coalesce(own.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(own.isNotNull(), F.xxhash64(own)), F.lit(null))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and continue from there (never localCheckpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Denser than a checkpoint; ``release`` removes the table once its readers are done.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` whose readers have all finished."""
    for df in frames:
        path = getattr(df, "_tidemark_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def bounded_slices(batch: pa.RecordBatch, column: str, limit: int = PART_BYTES, rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has at most ``rows`` rows and ``limit`` bytes of ``column`` (one row at least)."""
    ends = np.cumsum(_lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        stop = min(stop, start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def overlapping(text: bytes, k: int, limit: int = PART_BYTES) -> Iterator[bytes]:
    """``text`` in parts of about ``limit`` bytes, cut between words, each with the first k - 1 words of the next.

    So every run of k words lies in exactly one part.
    """
    s = 0
    while len(text) - s > limit:
        e = f = _WORD.match(text, s + limit).end() if _WORD.match(text, s + limit) else s + limit
        for _ in range(k - 1):
            word = _WORD.search(text, f)
            f = word.end() if word else len(text)
        if not _WORD.search(text, f):
            break
        yield text[s:f]
        s = e
    yield text[s:]


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts_of(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class Words:
    """All words of some texts, lower-cased in A-Z, in one buffer with single spaces between.

    ``buf[start[i]:end[i]]`` is word i, ``doc[i]`` the text it belongs to.
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            joined = _LOWER[joined]
        space = _SPACE[joined]
        keep = ~space
        first_space = space.copy()
        first_space[0] = False
        first_space[1:] &= keep[:-1]
        at = np.flatnonzero(first_space)  # one separator after each word
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(bounds, at, side="right")
        keep |= first_space
        buf = joined[keep].copy()
        ends = np.flatnonzero(_SPACE[buf])
        buf[ends] = 32
        self.buf, self.end = buf, ends
        self.start = np.empty_like(ends)
        if len(ends):
            self.start[0] = 0
            self.start[1:] = ends[:-1] + 1
        self.n_texts = len(texts)

    def shingles(self, k: int, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, start, end) of every k-word shingle; a shorter text's whole word sequence is its one shingle.

        ``whole``: which texts are whole ones; a shorter part of a text has no shingle.
        """
        counts = np.bincount(self.doc, minlength=self.n_texts)
        n = len(self.doc)
        if n >= k:
            i = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
            doc, start, end = self.doc[i], self.start[i], self.end[i + k - 1]
        else:
            doc = start = end = np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < k) & (True if whole is None else whole))
        if len(short):
            firsts = np.searchsorted(self.doc, short)
            doc = np.concatenate([doc, short])
            start = np.concatenate([start, self.start[firsts]])
            end = np.concatenate([end, self.end[firsts + counts[short] - 1]])
            order = np.argsort(doc, kind="stable")
            doc, start, end = doc[order], start[order], end[order]
        return doc, start, end


def shingle_hashes(texts: list[bytes], k: int, seed: int = 42) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, XXH64) of every k-word shingle, repeats included, some at a time; indices ascend."""
    at: list[int] = []
    parts: list[bytes] = []
    whole: list[bool] = []

    def found():
        words = Words(parts)
        doc, start, end = words.shingles(k, np.array(whole))
        return np.array(at)[doc], xxh64_ranges(words.buf, start, end, seed)

    size = 0
    for i, text in enumerate(texts):
        own = [text] if len(text) <= PART_BYTES else list(overlapping(text, k))
        for part in own:
            if parts and size + len(part) > PART_BYTES:
                yield found()
                at, parts, whole, size = [], [], [], 0
            at.append(i)
            parts.append(part)
            whole.append(len(own) == 1)
            size += len(part)
    if parts:
        yield found()


# XXH64's five primes: fixed values of the published algorithm.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``buf[start:end]``, vectorised over the ranges."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    lanes8 = np.ndarray((len(padded) - 8,), "<u8", padded, strides=(1,))
    lanes4 = np.ndarray((len(padded) - 4,), "<u4", padded, strides=(1,))
    size = end - start
    seed = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), seed + _P5, np.uint64)
        pos = start.astype(np.int64).copy()
        big = np.flatnonzero(size >= 32)
        if len(big):
            p, stripes = pos[big], size[big] // 32
            acc = [np.full(len(big), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            for s in range(int(stripes.max())):
                live = np.flatnonzero(stripes > s)
                for j in range(4):
                    acc[j][live] = _round(acc[j][live], lanes8[p[live] + 32 * s + 8 * j])
            v = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                v = (v ^ _round(np.uint64(0), a)) * _P1 + _P4
            h[big] = v
            pos[big] += 32 * stripes
        h += size.astype(np.uint64)
        for _ in range(3):
            live = np.flatnonzero(end - pos >= 8)
            if not len(live):
                break
            h[live] = _rotl(h[live] ^ _round(np.uint64(0), lanes8[pos[live]]), 27) * _P1 + _P4
            pos[live] += 8
        live = np.flatnonzero(end - pos >= 4)
        h[live] = _rotl(h[live] ^ (lanes4[pos[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        pos[live] += 4
        for _ in range(3):
            live = np.flatnonzero(end > pos)
            if not len(live):
                break
            h[live] = _rotl(h[live] ^ (padded[pos[live]].astype(np.uint64) * _P5), 11) * _P1
            pos[live] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns (node, component), both long.

    ``edges`` has long columns (a, b). Randomised contraction: in each round every node
    joins the neighbour with the least hash (or stays), edges are relabelled and made
    distinct, and the small map of that round is kept; node counts fall by a constant
    factor, so rounds grow with the logarithm of the longest path. Each round is written
    to the shared folder, so a lost executor costs no more than that round.
    """
    live = cut(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct())
    maps: list[DataFrame] = []
    for i in range(max_rounds):
        if live.isEmpty():
            break
        both = live.union(live.selectExpr("b", "a"))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(i), "b").alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64(F.lit(i), "a").alias("h"), F.col("a").alias("n"))
        to = cut(near.select(F.col("a").alias("node"), F.least("m", own)["n"].alias("root")))
        maps.append(to)
        left, right = to.toDF("a", "ra"), to.toDF("b", "rb")
        live = cut(
            live.join(left, "a").join(right, "b").where("ra <> rb").selectExpr("least(ra, rb) a", "greatest(ra, rb) b").distinct()
        )
    else:
        raise RuntimeError("components did not converge")
    spark = edges.sparkSession
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    found = maps[0]
    for to in maps[1:]:
        nxt = to.toDF("root", "next")
        found = found.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    found = cut(found)
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")


def component_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each of n nodes' components, for edges a-b, in memory."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
