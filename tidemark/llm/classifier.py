"""Ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= j) = sigmoid(t_j - s), with one score s = sum of hashed feature weights shared by
all grades and ordered thresholds t_0 < t_1 < ... The expected grade is the sum of the tail
probabilities P(grade >= j), and selection uses the tail probability of the wanted grade.

Features of a text, each present or not: its words (lower-cased in A-Z, trailing ASCII
punctuation cut), hashed; and, scaled by their share among the words, the hashed endings that
were cut and whether the word is in capitals. Whole texts are read.

The model is fitted on the driver by L-BFGS from at most ``max_rows`` labelled documents with
the least hashes of their ids, one text each: that bound limits what is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, Words, bound_batches, bounded_slices, texts_of, xxh64_ranges

BITS = 18
MAX_ROWS = 8_000
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the texts' features; rows ascend."""
    words = Words(texts, lower=False)
    if not len(words.doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    start, end = words.start, words.end.copy()
    for _ in range(4):
        cut = (end > start + 1) & _PUNCT[words.buf[np.maximum(end - 1, 0)]]
        if not cut.any():
            break
        end -= cut
    low = _LOWER[words.buf]
    mask = np.uint64((1 << bits) - 1)
    core = (xxh64_ranges(low, start, end, 1) & mask).astype(np.int64)
    tail = np.where(words.end > end, (xxh64_ranges(words.buf, end, words.end, 2) & mask).astype(np.int64), -1)
    caps = np.where((end - start > 1) & _UPPER[words.buf[start]] & _UPPER[words.buf[np.minimum(start + 1, len(words.buf) - 1)]], 1, -1)
    n = np.bincount(words.doc, minlength=len(texts)).astype(float)
    row_core, col_core = _unique(words.doc, core, bits)
    has = tail >= 0
    key, count = np.unique((words.doc[has] << bits) | tail[has], return_counts=True)
    row_tail, col_tail = key >> bits, key & ((1 << bits) - 1)
    row_caps = np.flatnonzero(np.bincount(words.doc[caps > 0], minlength=len(texts)))
    share = np.bincount(words.doc[caps > 0], minlength=len(texts))[row_caps] / n[row_caps]
    row = np.concatenate([row_core, row_tail, row_caps])
    col = np.concatenate([col_core, col_tail, np.full(len(row_caps), 1 << bits)])
    val = np.concatenate([np.ones(len(row_core)), 8 * count / n[row_tail], 8 * share])
    order = np.argsort(row, kind="stable")
    return row[order], col[order], val[order]


def _unique(row: np.ndarray, col: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((row << bits) | col)
    return key >> bits, key & ((1 << bits) - 1)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending
    bits: int = BITS

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade >= j) for j = 1..top, a row a text."""
        row, col, val = features(texts, self.bits)
        score = np.bincount(row, weights=self.weights[col] * val, minlength=len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit(row, col, val, grade, grades: int = 3, l2: float = 0.3, steps: int = 150, bits: int = BITS) -> Model:
    """Maximum penalised likelihood by L-BFGS. Thresholds are t_0 and sums of exponentials, so ordered."""
    n, width = len(grade), (1 << bits) + 1
    cols, at = np.unique(col, return_inverse=True)
    d, m = len(cols), grades - 1
    grade = np.asarray(grade)

    def loss(p):
        w, raw = p[:d], p[d:]
        t = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        s = np.bincount(row, weights=w[at] * val, minlength=n)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        hi, lo = edge[grade + 1] - s, edge[grade] - s
        f_hi, f_lo = 1 / (1 + np.exp(-np.clip(hi, -500, 500))), 1 / (1 + np.exp(-np.clip(lo, -500, 500)))
        prob = np.maximum(f_hi - f_lo, 1e-12)
        g_hi, g_lo = f_hi * (1 - f_hi), f_lo * (1 - f_lo)
        ds = (g_hi - g_lo) / prob  # of the negative log-likelihood
        grad_t = np.array([-(g_hi[grade == j] / prob[grade == j]).sum() + (g_lo[grade == j + 1] / prob[grade == j + 1]).sum() for j in range(m)])
        grad_raw = np.array([grad_t[j:].sum() for j in range(m)])
        grad_raw[1:] *= np.exp(raw[1:])
        grad_w = np.bincount(at, weights=ds[row] * val, minlength=d) + l2 * w
        value = -np.log(prob).sum() + l2 / 2 * (w @ w) + 1e-3 * (raw @ raw)
        return value, np.concatenate([grad_w, grad_raw + 2e-3 * raw])

    p = np.zeros(d + m)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 0.01, 0.99)
    t0 = np.log(share / (1 - share))
    p[d] = t0[0]
    p[d + 1 :] = np.log(np.maximum(np.diff(t0), 0.05))
    f, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ q)
            alphas.append(a)
            q -= a * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(g))
        for (s, y, r), a in zip(past, reversed(alphas)):
            q += s * (a - r * (y @ q))
        slope, step = -(g @ q), 1.0
        if slope >= 0:
            past, q, slope = [], g.copy(), -(g @ g)
        while step > 1e-10:
            new = p - step * q
            f2, g2 = loss(new)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - p, g2 - g
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y, 1 / (s @ y))]
        done = f - f2 < 1e-7 * abs(f)
        p, f, g = new, f2, g2
        if done:
            break
    weights = np.zeros(width)
    weights[cols] = p[:d]
    return Model(weights, np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])])), bits)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): toxic 0, poor 1, good 2; the lowest where rows disagree; unrated rows are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return (
        labels.select(F.col("doc_id").alias("doc_id"), grade.alias("grade"))
        .where("doc_id is not null and grade is not null")
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
    )


def train(docs: DataFrame, rated: DataFrame, grades: int = 3, max_rows: int = MAX_ROWS, bits: int = BITS, **kw) -> Model | None:
    """Fits on the ``max_rows`` rated documents with the least hashes of their ids; None if there are none.

    Of rows that share an id the least text counts, so the fit can be repeated; null ids don't count.
    """
    bound_batches(docs.sparkSession)
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for whole in batches:
            for batch in bounded_slices(whole, "text"):
                row, col, val = features(texts_of(batch.column("text")), bits)
                at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("grade"),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(col.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(val.astype(np.float32))),
                    ],
                    names=["doc_id", "grade", "col", "val"],
                )

    table = texts.mapInArrow(run, f"doc_id {kind}, grade int, col array<int>, val array<float>").toArrow()
    if not table.num_rows:
        return None
    order = pa.compute.sort_indices(table, [("doc_id", "ascending")])
    table = table.take(order).combine_chunks()
    lists = table["col"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(table.num_rows), size)
    return fit(
        row,
        lists.flatten().to_numpy().astype(np.int64),
        table["val"].combine_chunks().flatten().to_numpy().astype(float),
        table["grade"].to_numpy(),
        grades,
        bits=bits,
        **kw,
    )


def score(docs: DataFrame, model: Model | None, text: str = "text", keep_at: float = 0.5) -> DataFrame:
    """Adds expected_grade, p_top (the tail probability of the top grade) and kept to ``docs``.

    Null, empty and wordless texts score like a text without features. Without a model
    (nothing is rated) both numbers are null and every row is kept. Repeated rows score alike, an
    empty table gives an empty one, and columns of the three names are replaced.
    """
    bound_batches(docs.sparkSession)
    new = ["expected_grade", "p_top", "kept"]
    old = [c for c in docs.columns if c not in new]
    if model is None:
        return docs.select(*(F.col(f"`{c}`") for c in old)).withColumns(
            {"expected_grade": F.lit(None).cast("double"), "p_top": F.lit(None).cast("double"), "kept": F.lit(True)}
        )
    names = [f"c{i}" for i in range(len(old))]
    plain = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in zip(old, names)))
    own = plain.withColumn("_t", F.col(names[old.index(text)]))
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.bits))

    def run(batches):
        weights, thresholds, bits = sent.value
        local = Model(weights.astype(float), thresholds, bits)
        for whole in batches:
            for batch in bounded_slices(whole, "_t"):
                tails = local.tails(texts_of(batch.column("_t")))
                top = tails[:, -1]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(tails.sum(axis=1)), pa.array(top), pa.array(top >= keep_at)],
                    names=[*names, *new],
                )

    schema = plain.schema.add("expected_grade", "double").add("p_top", "double").add("kept", "boolean")
    return own.mapInArrow(run, schema).toDF(*old, *new)


def op2_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select("doc_id", "expected_grade", "p_top", "kept")
