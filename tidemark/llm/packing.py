"""Best-fit packing of documents into sequences of several permitted lengths.

Texts longer than the largest length are cut into pieces of that length; nothing is left
out. Equal rows are counted before anything is shuffled and numbered. Pieces are dealt into shards
of about ``shard_items`` by a hash of id, number, piece and length (so the number of shards grows
with the data and no shard does, however often an id or a null repeats), and each shard is packed
on its own:

* pieces go in decreasing length to the open bin, of whatever size, with the least room that
  still holds them (best fit over all permitted sizes jointly);
* if none holds it, the bin size of least cost is opened. Every opening rule that always
  prefers one permitted size is tried, and so is the rule that takes the least cost per token
  the shard can still put into it; the rule whose bins cost least in the end is kept;
* finally each bin is downsized to the cheapest permitted size that holds its contents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32
ATTENTION = 32_768
_COPIES = 10_000
WORDS = r"[^\x20\x09-\x0D]+"


def default_cost(capacity: int) -> float:
    """Work of a bin, padding included: a term per token, attention's quadratic term, a fixed overhead."""
    return capacity * (1 + capacity / ATTENTION) + OVERHEAD


def _fill(lengths: list[int], prefer, cost: dict[int, float], sizes: list[int]):
    """Best fit decreasing; lengths come sorted. Returns (bin of each, used, final size of each bin, cost)."""
    at, used, free = [0] * len(lengths), [], []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some open bin has r tokens of room
    left = sum(lengths)
    for i, n in enumerate(lengths):
        over = rooms >> n
        if over:
            room = n + (over & -over).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(used), prefer(n, left)
            used.append(0)
            free.append(room)
        used[b] += n
        at[i] = b
        left -= n
        room -= n
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    final = [min((c for c in sizes if c >= u), key=lambda c: (cost[c], c)) for u in used]
    return at, used, final, sum(cost[c] for c in final)


def pack_lengths(lengths: list[int], capacities=CAPACITIES, cost=default_cost):
    """(bin of each length, final capacity of each bin) for lengths sorted downwards, 1 to max(capacities)."""
    sizes = sorted(capacities)
    costs = {c: float(cost(c)) for c in sizes}

    def always(size):
        return lambda n, left: size if n <= size else next(c for c in sizes if c >= n)

    def ratio(n, left):
        return min((c for c in sizes if c >= n), key=lambda c: (costs[c] / min(c, left), c))

    best = None
    for rule in [ratio, *map(always, sizes)]:
        at, _, final, total = _fill(lengths, rule, costs, sizes)
        if best is None or total < best[2]:
            best = (at, final, total)
    return best[0], best[1]


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    length: str = "length",
    capacities=CAPACITIES,
    cost=default_cost,
    shard_items: int = 20_000,
) -> DataFrame:
    """Packs the rows of ``df`` by its column ``length``.

    Returns (id_col, piece, piece_start, piece_length, bin_id, bin_capacity, bin_used,
    bin_offset): one row a piece. A null, zero or negative length gives one row with
    piece_length 0 and no bin. Ids keep their type; null ids are packed like others. Ties go by
    id, then piece, so repeated rows are interchangeable. Bin ids are unique and do not depend on
    partitioning. An empty table gives an empty result; other columns of ``df`` are left out.
    """
    caps = sorted(set(int(c) for c in capacities))
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    if shard_items > 1 << 23:
        raise ValueError("shard_items must fit the bin ids' 24 bits")
    top = caps[-1]
    rows = df.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(length), F.lit(0)).cast("long"), F.lit(0)).alias("n"))
    kind = dict(rows.dtypes)["id"]
    counted = cut(rows.groupBy("id", "n").agg(F.count("*").alias("rows")))  # lengths are counted once, copies aggregated
    n_items = counted.agg(F.sum(F.ceil(F.col("n") / top) * F.col("rows"))).first()[0] or 0
    shards = max(1, -(-int(n_items) // shard_items))
    # blocks of copies first, so that no array is long
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {_COPIES}"))).alias("block")
    each = counted.select("id", "n", "rows", block).select(
        "id", "n", F.explode(F.expr(f"sequence(block * {_COPIES}, least(rows, (block + 1) * {_COPIES}) - 1)")).alias("copy")
    )
    pieces = each.where("n > 0").select("id", "n", "copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / top).cast("int") - 1)).alias("piece")).select(
        "id", "copy", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece").cast("long") * top).cast("int").alias("len")
    )
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "copy", "piece", "len"), F.lit(shards))).drop("copy")
    schema = f"id {kind}, piece int, start long, len int, bin_id long, cap int, used int, off int"

    def run(table: pa.Table) -> pa.Table:
        keys = [("len", "descending"), ("id", "ascending"), ("piece", "ascending")]
        t = table.take(pa.compute.sort_indices(table, keys, null_placement="at_start"))
        lengths = t["len"].to_pylist()
        at, final = pack_lengths(lengths, caps, cost)
        if len(final) > 1 << 24:
            raise ValueError("a shard has too many bins for the ids")
        n = np.array(lengths, np.int64)
        at = np.array(at, np.int64)
        order = np.argsort(at, kind="stable")
        run_up = np.cumsum(n[order]) - n[order]
        firsts = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
        off = np.empty(len(n), np.int64)
        off[order] = run_up - np.repeat(run_up[firsts], np.diff(np.append(firsts, len(n))))
        used = np.bincount(at, weights=n).astype(np.int64)
        shard = t["shard"][0].as_py()
        return pa.table(
            {
                "id": t["id"], "piece": t["piece"], "start": t["start"], "len": t["len"],
                "bin_id": pa.array((np.int64(shard) << 24) + at), "cap": pa.array(np.array(final, np.int32)[at]),
                "used": pa.array(used[at].astype(np.int32)), "off": pa.array(off.astype(np.int32)),
            }
        )

    packed = pieces.groupBy("shard").applyInArrow(run, schema)
    none = each.where("n = 0").selectExpr(
        "id", "0 piece", "0L start", "0 len", "cast(null as long) bin_id", "cast(null as int) cap", "cast(null as int) used", "cast(null as int) off"
    )
    return packed.unionByName(none).toDF(
        id_col, "piece", "piece_start", "piece_length", "bin_id", "bin_capacity", "bin_used", "bin_offset"
    )


def pack_documents(docs: DataFrame, text: str = "text", **kw) -> DataFrame:
    """``pack`` by the number of words of the whole text (null: none)."""
    return pack(docs.select("doc_id", F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).alias("length")), **kw)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
