"""Approximate nearest neighbours by inverted lists and adaptive dimension scans.

An index of k-means lists is fitted on at most ``sample`` vectors (those with the least hashes
of their ids) and holds every vector. A query probes its nearest lists, as many as reach a share
``target`` of the true neighbours within the sample, and more where these hold too few vectors:
on until they hold k besides its own, or all lists. Within a list, vectors are rotated by a fixed random orthogonal matrix and read in blocks of columns: after d of D
columns the partial distance, scaled by D / d, estimates the whole, and a candidate is
abandoned once the hypothesis that it beats the current k-th best is rejected, that is when
the estimate exceeds that distance by more than the factor (1 + eps / sqrt(d))^2. Survivors
get their exact distance on the original vectors in double precision.

Equal vectors: only the k + 1 smallest ids of a vector can appear in a result (ties go to the
smaller id), so the others are left out before the shuffle, exactly. Lists and the queries that
probe them are dealt out in parts of bounded size, so a crowded list is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

K = 10
SAMPLE = 20_000
MAX_LISTS = 4_096
EPS = 2.1
PART_ROWS = 20_000
PART_QUERIES = 2_000
PART_ASSIGNED = 512
BLOCK = 16


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of Lloyd's algorithm; empty lists keep their centre."""
    centres = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)].astype(float)
    for _ in range(rounds):
        at = nearest(x, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        n = np.bincount(at, minlength=lists)
        centres[n > 0] = total[n > 0] / n[n > 0][:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest centres of each row, nearest first."""
    out = np.empty((len(x), n), np.int64)
    half = (centres**2).sum(axis=1) / 2
    for s in range(0, len(x), 4096):
        d = half - x[s : s + 4096] @ centres.T
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.broadcast_to(np.arange(len(centres)), d.shape)
        out[s : s + 4096] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1)
    return out


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, target: float, tried: int = 400) -> int:
    """Lists to probe so that, within the sample, a share ``target`` of true neighbours is reached."""
    asked = x[:: max(1, len(x) // tried)]
    half = (x**2).sum(axis=1) / 2
    order = np.argsort((centres**2).sum(axis=1) / 2 - asked @ centres.T, axis=1)
    place = np.argsort(order, axis=1)
    home = nearest(x, centres, 1)[:, 0]
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    near = np.argpartition(half - asked @ x.T, k, axis=1)[:, : k + 1]
    need = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(target * len(need))))]) + 1


def scan(ids: np.ndarray, x: np.ndarray, rotated: np.ndarray, qid: int, q: np.ndarray, q_rot: np.ndarray, k: int, eps: float = EPS):
    """(ids, distances) of the k best candidates of one list other than ``qid``, ties to the smaller id."""
    dim = x.shape[1]
    alive = np.flatnonzero(ids != qid)
    if not len(alive):
        return ids[:0], np.zeros(0)
    part = ((rotated[alive, :BLOCK] - q_rot[:BLOCK]) ** 2).sum(axis=1)
    if len(alive) > k:
        seeds = alive[np.argpartition(part, k - 1)[:k]]
        bound = ((x[seeds] - q) ** 2).sum(axis=1).max() * (1 + 1e-9)
        done = min(BLOCK, dim)
        while True:
            keep = part * (dim / done) <= bound * (1 + eps / np.sqrt(done)) ** 2 if done < dim else part <= bound * (1 + 1e-6) + 1e-9
            alive, part = alive[keep], part[keep]
            if done >= dim:
                break
            part = part + ((rotated[alive, done : done + BLOCK] - q_rot[done : done + BLOCK]) ** 2).sum(axis=1)
            done = min(done + BLOCK, dim)
        alive = np.union1d(alive, seeds)
    exact = np.sqrt(((x[alive] - q) ** 2).sum(axis=1))
    best = np.lexsort((ids[alive], exact))[:k]
    return ids[alive[best]], exact[best]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def usable(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, vec) of the vectors that take part: not null, finite throughout, not zero, id not null."""
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda v: v != 0)
    )


def search(
    df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec: str = "embedding", k: int = K, target: float = 0.97, sample: int = SAMPLE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``df`` found for each row of ``queries``.

    Euclidean distance in double precision; a row of the query's own id is no candidate. Vectors
    that are null, zero or not finite take no part, nor do those whose length is not the commonest
    one. A query has k rows, or one for each candidate if the table has fewer. Components keep
    their type (float or double). Ids must be integers; a null id takes no part, and rows that
    repeat an id are candidates each. An empty table, or no queries, gives no rows.
    """
    spark = df.sparkSession
    good = usable(df, id_col, vec)
    asked = usable(queries, id_col, vec)
    sizes = good.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out_schema)
    dim, total = sizes
    good, asked = good.where(F.size("vec") == dim), asked.where(F.size("vec") == dim)
    rows = min(sample, max(1_000, 20_000_000 // dim))
    drawn = good.orderBy(F.xxhash64("id"), "id").limit(rows).select("vec").toArrow()
    turn = rotation(dim)
    known = np.unique(_matrix(drawn["vec"]), axis=0)
    lists = max(1, min(MAX_LISTS, int(total**0.5), len(known) // 8 or 1))
    centres = kmeans(known, lists)
    probes = min(lists, probes_for(known, centres, k, target))
    sent = spark.sparkContext.broadcast((centres, turn))

    def assign(rows_of: np.ndarray | None):
        """To the nearest list, or, given how many vectors each list holds, to all that are probed."""

        def run(batches):
            centres, _ = sent.value
            for batch in batches:
                for s in range(0, batch.num_rows, PART_ASSIGNED):
                    part = batch.slice(s, PART_ASSIGNED)
                    x = _matrix(part.column("vec"))
                    if rows_of is None:
                        at, row = nearest(x, centres, 1)[:, 0], np.arange(len(x))
                    else:
                        order = nearest(x, centres, len(centres))
                        held = np.cumsum(rows_of[order], axis=1)
                        enough = np.minimum((held <= k).sum(axis=1) + 1, len(centres))
                        row, place = np.nonzero(np.arange(len(centres)) < np.maximum(enough, probes)[:, None])
                        at = order[row, place]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at.astype(np.int32)), part.column("id").take(pa.array(row)), part.column("vec").take(pa.array(row))], names=["list", "id", "vec"]
                    )

        return run

    kind = "float" if dict(df.dtypes)[vec] == dict(queries.dtypes)[vec] == "array<float>" else "double"
    schema = f"list int, id long, vec array<{kind}>"
    typed = F.col("vec").cast(f"array<{kind}>").alias("vec")
    least = W.partitionBy("vec").orderBy("id")
    distinct = good.select("id", typed).withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1).drop("nth")
    index = cut(distinct.mapInArrow(assign(None), schema))
    rows_of = np.zeros(lists, np.int64)
    for at, n in index.groupBy("list").count().collect():  # MAX_LISTS rows at most
        rows_of[at] = n
    wanted = cut(asked.select("id", typed).mapInArrow(assign(rows_of), schema))
    # at most MAX_LISTS rows
    parts = index.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("chunks"))
    blocks = wanted.groupBy("list").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("blocks"))
    deal = F.broadcast(cut(parts.join(blocks, "list")))
    cells = index.join(deal, "list").select(
        "list", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "vec"
    )
    probing = wanted.join(deal, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "vec"
    )

    def look(asking: pa.Table, held: pa.Table) -> pa.Table:
        _, turn = sent.value
        found = []
        if asking.num_rows and held.num_rows:
            x, ids = _matrix(held["vec"]), held["id"].to_numpy()
            rotated, q = x @ turn, _matrix(asking["vec"])
            q_rot = q @ turn
            for i, qid in enumerate(asking["id"].to_pylist()):
                near, dist = scan(ids, x, rotated, qid, q[i], q_rot[i], k)
                found.append((np.full(len(near), qid), near, dist))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2])})

    key = ["list", "chunk", "block"]
    found = probing.groupBy(*key).cogroup(cells.groupBy(*key)).applyInArrow(look, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where("vec_id % 100 = 0"))
