"""Byte-level BPE by ranks: encode with segment trees over byte positions, and decode.

A pattern cuts a text into pieces; a piece that is itself a token is that token. In any
other piece, a segment tree over byte positions holds, for each live position, the rank of
the pair that starts there; each node keeps the least rank of its range and, among equal
ranks, the leftmost position (rank and position are packed into one integer, so the minimum
does both). A merge reads the root, joins the pair and makes point updates, logarithmic in
the piece, at the merged position, at the position it swallowed and at the live neighbour
on the left. Short pieces of a batch are merged together, one tree a row of a matrix; a long
piece has a tree of its own, so a piece of n bytes costs O(n log n) whatever it holds.

Encoded pieces are kept in a bounded table per Python worker; this changes no result.
"""

from __future__ import annotations

import base64
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, bounded_slices

_INF = np.int64(1) << 62
_ALONE = 256  # bytes from which a piece gets a tree of its own
_CACHE = 96 << 20  # bytes, as counted, that a worker's table of encoded pieces may have
_ENCODERS: dict[int, Encoder] = {}  # of a Python worker; the last one used
_LONG = 1 << 20  # characters from which a text is encoded part by part
_ENTRY = 200  # bytes that an entry takes besides its text and its ids


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks. The driver reads it."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Merger:
    """Merges pieces by rank. ``ranks`` must hold every single byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.span = max(ranks.values()) + 1
        codes, ids = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    codes.append(a * self.span + b)
                    ids.append(rank)
        codes, ids = np.array(codes, np.int64), np.array(ids, np.int64)
        order = np.argsort(codes)
        self.codes, self.ids = np.append(codes[order], _INF), np.append(ids[order], 0)
        both = np.arange(1 << 16)
        self.first = self._rank(self.byte[both >> 8], self.byte[both & 255]).astype(np.int32).reshape(256, 256)
        self._pairs: dict[int, int] | None = None

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) * self.span + b
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.ids[at], -1)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            known = self.ranks.get(p)
            if known is not None:
                out[i] = [known]
            elif len(p) >= _ALONE:
                out[i] = self._one(p)
            elif p:
                by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
            else:
                out[i] = []
        for width, at in by_width.items():
            step = max(1, (1 << 16) // width)
            for s in range(0, len(at), step):
                part = at[s : s + step]
                for i, ids in zip(part, self._forest([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _forest(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """All pieces (2 to ``width`` bytes) at once, a tree a row.

        A node's value is rank * width + position. All arrays are flat: a row's first cell is
        ``base`` in ``token``, ``after`` and ``before``, and 2 * ``base`` in ``tree``.
        """
        n, none = len(pieces), np.int32(np.iinfo(np.int32).max)
        size = np.array([len(p) for p in pieces], np.int32)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        place = np.arange(width, dtype=np.int32)
        inside = place < size[:, None]
        trees = np.full((n, 2 * width), none, np.int32)
        first = self.first[raw[:, :-1], raw[:, 1:]]
        trees[:, width:-1] = np.where((first >= 0) & inside[:, 1:], first * np.int32(width) + place[:-1], none)
        for node in range(width - 1, 0, -1):
            np.minimum(trees[:, 2 * node], trees[:, 2 * node + 1], out=trees[:, node])
        token, tree = self.byte[raw].ravel(), trees.ravel()
        after = np.minimum(place + 1, size[:, None]).ravel()  # next live position; the size at the end
        before = np.broadcast_to(place - 1, (n, width)).ravel().copy()
        alive = inside.ravel().copy()
        levels = width.bit_length() - 1

        def put(base, pos, value):
            node = pos + width
            tree[base + node] = value
            for _ in range(levels):
                node = node >> 1
                low = base + 2 * node
                tree[base + node] = np.minimum(tree[low], tree[low + 1])

        rows = np.flatnonzero(trees[:, 1] < none)
        while len(rows):
            base = rows * width
            top = tree[2 * base + 1]
            pos, merged = top & (width - 1), top >> levels
            gone = after[base + pos]
            right = after[base + gone]
            token[base + pos] = merged
            alive[base + gone] = False
            after[base + pos] = right
            fits = np.flatnonzero(right < size[rows])
            before[base[fits] + right[fits]] = pos[fits]
            value = np.full(len(rows), none)
            found = self._rank(merged[fits], token[base[fits] + right[fits]])
            value[fits] = np.where(found >= 0, found * width + pos[fits], none)
            left = before[base + pos]
            has = np.flatnonzero(left >= 0)
            near = left[has]
            found = self._rank(token[base[has] + near], merged[has])
            # the swallowed position, the merged one and its left neighbour, in one pass up the tree
            put(
                2 * np.concatenate([base, base, base[has]]),
                np.concatenate([gone, pos, near]),
                np.concatenate([np.full(len(rows), none), value, np.where(found >= 0, found * width + near, none).astype(np.int32)]),
            )
            rows = rows[tree[2 * base + 1] < none]
        alive = alive.reshape(n, width)
        ends = np.cumsum(alive.sum(axis=1)).tolist()
        flat = token.reshape(n, width)[alive].tolist()
        return [flat[s:e] for s, e in zip([0, *ends[:-1]], ends)]

    def _one(self, piece: bytes) -> list[int]:
        """One long piece, in O(n log n) time and some 30 bytes of memory a byte.

        Here a node holds the position of its leftmost least rank, so all arrays are of 32 bits.
        """
        if self._pairs is None:
            self._pairs = dict(zip(self.codes[:-1].tolist(), self.ids[:-1].tolist()))
        pairs, span, n = self._pairs, self.span, len(piece)
        width, none = 1 << (n - 1).bit_length(), np.iinfo(np.int32).max
        arr = np.frombuffer(piece, np.uint8)
        first = np.full(width, none, np.int32)
        first[: n - 1] = self.first[arr[:-1], arr[1:]]
        first[first < 0] = none
        levels = [np.arange(width, dtype=np.int32)]
        while len(levels[-1]) > 1:
            a, b = levels[-1][::2], levels[-1][1::2]
            levels.append(np.where(first[a] <= first[b], a, b))
        # node i's children are 2 i and 2 i + 1; leaves aren't kept
        tree = _ints(np.concatenate([np.zeros(1, np.int32), *reversed(levels[1:])]))
        rank, token = _ints(first), _ints(self.byte[arr])
        after, before = _ints(np.arange(1, n + 1, dtype=np.int32)), _ints(np.arange(-1, n - 1, dtype=np.int32))
        alive = bytearray(b"\1") * n
        half = width // 2

        def put(pos, value):
            rank[pos] = value
            node = (pos + width) >> 1
            a = pos & ~1
            low = a if rank[a] <= rank[a + 1] else a + 1
            while True:
                if tree[node] == low != pos:
                    return
                tree[node] = low
                node >>= 1
                if not node:
                    return
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if rank[a] <= rank[b] else b

        while half and rank[tree[1]] < none:
            pos = tree[1]
            merged, gone = rank[pos], after[pos]
            right = after[gone]
            token[pos], alive[gone], after[pos] = merged, 0, right
            put(gone, none)
            found = None
            if right < n:
                before[right] = pos
                found = pairs.get(merged * span + token[right])
            put(pos, none if found is None else found)
            left = before[pos]
            if left >= 0:
                found = pairs.get(token[left] * span + merged)
                put(left, none if found is None else found)
        return np.frombuffer(token, np.int32)[np.frombuffer(alive, np.uint8) > 0].tolist()


def _ints(values: np.ndarray) -> array:
    """32-bit integers whose items are read and written one by one faster than NumPy's."""
    out = array("i")
    out.frombytes(values.astype(np.int32).tobytes())
    return out


class Encoder:
    """Whole texts to ids, without special tokens. Ids are held as little-endian int32 bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merger = Merger(ranks)
        compiled = regex.compile(pattern)
        self.cut = (lambda text: [m[0] for m in compiled.finditer(text)]) if compiled.groups else compiled.findall
        self.safe = regex.compile(r"(?<=\S) (?=\S)")
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        ids = self.merger.encode(raw)
        flat, at = np.fromiter(chain.from_iterable(ids), "<i4", sum(map(len, ids))).tobytes(), 0
        for p, r, x in zip(pieces, raw, ids):
            self.known[p] = flat[at : at + 4 * len(x)]
            at += 4 * len(x)
            self.held += len(r) + 4 * len(x) + _ENTRY

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Pieces are remembered up to ``_CACHE`` bytes beyond those of the texts themselves."""
        if self.held > _CACHE:
            self.known, self.held = {}, 0
        cuts = [self.cut(t) if len(t) <= _LONG else None for t in texts]
        self._learn(list(set().union(*(c for c in cuts if c)).difference(self.known)))
        get = self.known.__getitem__
        return [self._long(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cuts)]

    def _long(self, text: str) -> bytes:
        """A long text, part by part, cut at spaces between characters that aren't white space: no match crosses these."""
        out, s = [], 0
        while s < len(text):
            space = self.safe.search(text, s + _LONG)
            e = space.start() if space else len(text)
            pieces = self.cut(text[s:e])
            if self.held > _CACHE:
                self.known, self.held = {}, 0
            self._learn(list(set(pieces).difference(self.known)))
            out.append(b"".join(map(self.known.__getitem__, pieces)))
            s = e
        return b"".join(out)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out`` (array of int): the token ids of the whole ``text``; null and empty give [].

    The rank file is read on the driver and broadcast; its size is that of the vocabulary.
    Rows are kept as they are, repeated ones too; an empty table gives an empty one. A column
    ``out`` of ``df`` is replaced.
    """
    bound_batches(df.sparkSession)
    df = df.drop(out) if out != text else df
    ranks = read_ranks(ranks_path)
    sent, name = df.sparkSession.sparkContext.broadcast((ranks, pattern)), hash((pattern, frozenset(ranks.items())))
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names).withColumn("_text", F.col(names[df.columns.index(text)]))

    def run(batches):
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(*sent.value)
        encoder = _ENCODERS[name]
        for whole in batches:
            for batch in bounded_slices(whole, "_text", 2 << 20, 1 << 16):
                ids = encoder.encode([t or "" for t in batch.column("_text").to_pylist()])
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
                flat = np.frombuffer(b"".join(ids), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], names=[*names, "_ids"])

    schema = df.toDF(*names).schema.add("_ids", T.ArrayType(T.IntegerType()))
    return plain.mapInArrow(run, schema).toDF(*df.columns, out)


_TOKENS = 1 << 18  # decoded at once


def _table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens in one buffer: (bytes, start and size by id; size -1 where there is no such id)."""
    start, size = (np.full(max(ranks.values()) + 1, x, np.int64) for x in (0, -1))
    tokens = sorted(ranks.items(), key=lambda x: x[1])
    ids = np.array([i for _, i in tokens])
    size[ids] = [len(t) for t, _ in tokens]
    start[ids] = np.cumsum(size[ids]) - size[ids]
    return np.frombuffer(b"".join(t for t, _ in tokens), np.uint8), start, size


def _decoded(lists: pa.ListArray, joined: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of lists of ids, gathered at once."""
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    many = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=many[1:])
    if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or (size[ids] < 0).any()):
        raise ValueError("an id is not in the vocabulary")
    n = size[ids]
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    data = joined[np.arange(int(ends[-1])) + np.repeat(start[ids] - ends[:-1], n)]
    offsets = ends[many]
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("a text has over 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` (binary): the bytes of the token ids; null ids give no bytes. An unknown id is an error.

    A column ``out`` of ``df`` is replaced.
    """
    bound_batches(df.sparkSession)
    df = df.drop(out) if out != ids else df
    sent = df.sparkSession.sparkContext.broadcast(_table(read_ranks(ranks_path)))
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names).withColumn("_ids", F.col(names[df.columns.index(ids)]))

    def run(batches):
        joined, start, size = sent.value
        for batch in batches:
            lists = batch.column("_ids")
            ends = lists.offsets.to_numpy()
            s = 0
            while s < batch.num_rows:  # some tokens at a time, one row at least
                e = max(s + 1, int(np.searchsorted(ends, ends[s] + _TOKENS, side="right")) - 1)
                part = batch.slice(s, e - s)
                texts = _decoded(part.column("_ids"), joined, start, size)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), texts], names=[*names, "_out"])
                s = e

    schema = df.toDF(*names).schema.add("_out", "binary")
    return plain.mapInArrow(run, schema).toDF(*df.columns, out)


def op8_bpe(spark, sf_dir: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, ranks_path, pattern).drop("text")
    both = decode(ids, ranks_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
