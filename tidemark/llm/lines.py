"""Near-duplicate lines by an exact set-similarity join, in DataFrame and SQL functions only.

A line is a set of lower-cased words; a line with at least ``MIN_TOKENS`` of them is removed if
an earlier line (by document id, then place) is at least 0.8 similar (Jaccard), whether or not
that line is itself removed. The join:

* Lines with equal sets are one class, known by its earliest line; all its other lines go.
* Words are ordered by length, the longest first, then by hash: long words are mostly rare ones. Any
  total order is exact; this one needs no count over the corpus and decides how short the candidate
  lists are.
* The keys of a line are the pairs of neighbours in that order. Of the o - 1 neighbouring pairs of
  o shared tokens, each token that only one line has breaks at most one, so lines of n and m words
  that are similar (9 o >= 4 (n + m)) share (n + m) / 3 - 1 keys or more. Hence the prefix filter:
  the first shared key is among the first (2 n - m) / 3 + 1 of the one and (2 m - n) / 3 + 1 of the
  other. A frequent token is thereby split by its neighbour, exactly.
* Lines that share a key must pass the length filter, and then that of their sketches: 64 bits, each
  the parity of the number of words with that hash (later 128 more, of other hashes, for longer
  lines). Every word that only one line has flips one bit of each, so similar lines differ in
  (n + m) / 9 bits at most.
* In a crowd of variants all pairs would be quadratic, so at keys of over ``CROWD`` classes each
  class first meets only the key's first class. Whatever that removes needs no other partner; of the
  others those with any earlier class of like sketch at a key are looked for (a semi-join, so a row
  each at most), and for these a semi-join on the whole sets stops at the first similar one.
* Pairs are verified on the whole sets in integers: 9 * overlap >= 4 * (n + m), each line with the
  earlier one of the nearest sketch first, and only if that one is not similar with its others.

Words are compared by their length and 57 bits of XXH64, sets by 64 bits of
these numbers, their sketch and their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, number, release, written

MIN_TOKENS = 5
CROWD = 32
_BROADCAST_NUMBERS = 1_000_000
_LONG = 255  # words of a line; the keys carry no larger number
_WIDE = 80  # words of a line; longer ones have 128 more bits of sketch


def _spaced(text: str) -> str:
    """SQL: lower case, with a space for every white space that doesn't end a line."""
    out = f"lower({text})"
    for c in ("\\t", "\\u000B", "\\u000C", "\\r"):
        out = f"replace({out}, '{c}', ' ')"
    return out


_TOKEN = "(shiftleft(cast(63 - least(octet_length({0}), 63) as bigint), 57) | shiftrightunsigned(xxhash64({0}), 7))"


def _hashes(line: str) -> str:
    """SQL: the distinct words of a line, as numbers: 6 bits that fall with the length, then 57 of a hash."""
    return f"array_remove(array_distinct(transform(split({_spaced(line)}, ' '), w -> {_TOKEN.format('w')})), {_TOKEN.format(repr(''))})"


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))


def _keyed(docs: DataFrame, min_tokens: int) -> DataFrame:
    """(id, k1, k2, line, n, hash, sketch, wide0, wide1, keys) of every line with ``min_tokens`` words: its words, its set, the prefix of its keys (40 bits each)."""
    # the id is no function of the row, so the filter stays behind it and the words are split once
    words = _lines(docs).select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "line", F.expr(f"sort_array({_hashes('s')})").alias("_k"))
    keyed = words.withColumn("n", F.size("_k")).where(F.col("n") >= min_tokens).withColumn("_p", F.expr(_prefix("n")))
    return keyed.select(
        "id", "k1", "k2", "line", "n", F.xxhash64("_k").alias("hash"),
        F.expr("aggregate(_k, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))").alias("sketch"),
        *(F.expr(f"IF(n <= {_WIDE}, 0L, aggregate(filter(_k, x -> x & 64 = {64 * i}), 0L, (a, x) -> a ^ shiftleft(1L, cast(shiftright(x, 7) & 63 as int))))").alias(f"wide{i}") for i in (0, 1)),
        F.expr("zip_with(slice(_k, 1, _p), slice(_k, 2, _p), (x, y) -> shiftrightunsigned(xxhash64(x, y), 24))").alias("keys"),
    )


def _prefix(n: str) -> str:
    """SQL: the longest prefix of keys, that for the shortest partner; fewer than 4 words are similar to equal sets only."""
    return f"IF({n} < 4, 0, least({n} - 1, cast(floor((2 * {n} - ceil({n} * 4 / 5)) / 3) as int) + 1))"


def _sent(df: DataFrame, numbers: int) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``_BROADCAST_NUMBERS`` lines or ids (of 64 bytes at most each)."""
    return F.broadcast(df) if numbers <= _BROADCAST_NUMBERS else df


_PLACE = ["k1", "k2", "line"]


def _apart(a: str, b: str, *sketches: str):
    """The bits in which the sketches of lines a and b differ."""
    return sum((F.bit_count(F.col(a + s).bitwiseXOR(F.col(b + s))) for s in sketches), F.lit(0))


def _alike(a: str, b: str, n, m):
    """Whether lines a and b of n and m words, which are all known, may be similar by these and by their sketches."""
    wide = (F.least(n, m) <= _WIDE) | (9 * _apart(a, b, "wide0", "wide1") <= n + m)
    return (9 * F.least(n, m) >= 4 * (n + m)) & (9 * _apart(a, b, "sketch") <= n + m) & wide


def _similar(words: str, others: str):
    return 9 * F.size(F.array_intersect(words, others)) >= 4 * (F.size(words) + F.size(others))


def similar_lines(docs: DataFrame, repeated: bool = True, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(k1, k2, lines): the places of lines to remove, for documents (k1, k2, text) that lose any.

    ``repeated``: whether a key may occur twice (with one text).
    """
    table = written(_keyed(docs, min_tokens), "lines")
    place, same = F.struct(*_PLACE), ["hash", "sketch", "n"]
    # counted with fixed-width values, which need no sort; the places only of classes with several lines
    several = table.groupBy(*same).agg(F.min("k1").alias("k1"), F.count("*").alias("members")).where("members > 1")
    several = cut(several.select(*same, "k1"))
    earliest = table.join(_sent(several, several.count()), [*same, "k1"], "left_semi").groupBy(*same).agg(F.min(place).alias("first"))
    several = written(earliest, "classes")
    copies = _sent(several, several.count())
    once = table.join(copies, same, "left").where(F.col("first").isNull() | (F.col("first") == place))
    # a key, the line's sketch, and in one number its id and its words; the rows before it at its key, if these are few
    own = F.shiftleft("id", 8).bitwiseOR(F.least("n", F.lit(_LONG)).cast("long")).alias("own")
    at_key = W.partitionBy("key")
    posts = once.select(own, "sketch", F.explode("keys").alias("key")).withColumn("size", F.count("*").over(at_key)).where("size > 1")
    few = F.when(F.col("size") <= CROWD, F.struct("own", "sketch"))  # a crowd's lists stay empty
    before = F.collect_list(few).over(at_key.orderBy("own").rowsBetween(W.unboundedPreceding, -1))
    nothing = F.array(F.struct(F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("sketch")))
    posts = posts.withColumn("before", before).withColumn("o", F.explode(F.when(F.col("size") <= CROWD, F.col("before")).otherwise(nothing)))
    n, m = (F.col(c).bitwiseAND(F.lit(_LONG)) for c in ("own", "o.own"))
    apart = _apart("", "o.", "sketch")
    alike = (F.greatest(n, m) == _LONG) | (9 * F.least(n, m) >= 4 * (n + m)) & (9 * apart <= n + m)
    crowded = F.col("size") > CROWD
    met = posts.where(crowded | alike).select(F.when(crowded, F.col("key")).alias("key"), F.shiftright("own", 8).alias("id"), F.shiftright("o.own", 8).alias("other"))
    met = written(met, "met")
    sketches = ["n", "sketch", "wide0", "wide1"]
    rows = written(table.select("id", "hash", *sketches, *_PLACE), "rows")
    release(table)  # its keys are most of the disk
    of_lines = rows.select("id", place.alias("p"), *sketches)
    n, m = F.col("a.n"), F.col("b.n")
    light = cut(met.where("key is null").select("id", "other").distinct())
    crowded = cut(met.where("key is not null").select("id", "key"))
    posted = crowded.count()
    used = light.select("id").union(light.select("other"))
    used = cut((used if posted <= _BROADCAST_NUMBERS else used.union(crowded.select("id"))).distinct())
    mine = cut(of_lines.join(_sent(used, used.count()), "id", "left_semi"))
    likely = light.join(mine.alias("a"), "id").join(mine.withColumnRenamed("id", "other").alias("b"), "other")
    likely = likely.where(_alike("a.", "b.", n, m)).where("a.p <> b.p")
    likely = likely.select(F.greatest("a.p", "b.p").alias("p"), F.least("a.p", "b.p").alias("earlier"), _apart("a.", "b.", "sketch").alias("apart"))
    crowd = of_lines if posted <= _BROADCAST_NUMBERS else mine
    crowd = written(crowd.join(_sent(crowded, posted), "id").select("key", "p", *sketches), "crowd")
    lead = cut(crowd.groupBy("key").agg(F.min(F.struct("p", *sketches)).alias("o")).select("key", "o.*"))
    behind = (F.col("a.key") == F.col("b.key")) & _alike("a.", "b.", n, m) & (F.col("a.p") > F.col("b.p"))
    star = crowd.alias("a").join(_sent(lead, lead.count()).alias("b"), behind).select("a.p", F.col("b.p").alias("earlier"), _apart("a.", "b.", "sketch").alias("apart"))
    pairs = written(likely.union(star.distinct()), "pairs")

    def words_of(used: DataFrame) -> DataFrame:
        """(p, words) of the lines ``used``, and of some others: those whose hash has its bit in a bitmap of 2^26 bits.

        So no text is shuffled, and what is broadcast has 2^20 rows at most.
        """
        slot = F.xxhash64(*_PLACE)
        word, bit = F.shiftrightunsigned(slot, 44).alias("word"), F.expr(f"shiftleft(1L, cast(xxhash64({', '.join(_PLACE)}) & 63 as int))")
        used = cut(used.select("p.*"))
        bitmap = cut(used.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")))
        at = cut(used.select("k1", "k2").distinct())
        texts = docs.join(F.broadcast(at), ["k1", "k2"], "left_semi") if at.count() <= _BROADCAST_NUMBERS else docs
        texts = texts.dropDuplicates(["k1", "k2"]) if repeated else texts
        rows = _lines(texts).withColumn("word", word).join(F.broadcast(bitmap), "word").where(F.col("bits").bitwiseAND(bit) != 0)
        return written(rows.select(place.alias("p"), F.expr(_hashes("s")).alias("words")), "sets")

    def similar(pairs: DataFrame) -> DataFrame:
        """The lines p of pairs (p, earlier) that are similar, by their whole sets; only sets that a pair needs are shuffled, if pairs are few."""
        pairs, others = cut(pairs), sets.toDF("earlier", "others")
        number = pairs.count()
        if number <= _BROADCAST_NUMBERS:
            others = others.join(F.broadcast(pairs.select("earlier").distinct()), "earlier", "left_semi")
        both = sets.join(_sent(pairs, number), "p").join(others, "earlier")
        return cut(both.where(_similar("words", "others")).select("p").distinct())

    def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
        return rows.join(_sent(gone, gone.count()), "p", "left_anti")

    sets = words_of(pairs.select("p").union(pairs.select("earlier")))
    nearest = F.min(F.struct("apart", "earlier")).alias("o")
    gone = similar(pairs.groupBy("p").agg(nearest).select("p", "o.earlier"))
    gone = gone.union(similar(without(pairs, gone).select("p", "earlier").distinct()))
    live = crowd.alias("a").join(crowd.alias("b"), behind, "left_semi")  # both sides by one shuffle
    live = written(without(live, gone), "live")
    more = None
    if not live.isEmpty():
        # of a crowd only the lines that some live one is like, a row each
        earlier = written(crowd.alias("b").join(_sent(live, live.count()).alias("a"), behind, "left_semi"), "earlier")
        more = words_of(live.select("p").union(earlier.select("p")).distinct())
        whole = earlier.join(more, "p").alias("b")
        found = live.join(more, "p").alias("a").join(whole, behind & _similar("a.words", "b.words"), "left_semi")
        gone = gone.union(cut(found.select("p").distinct())).distinct()
    # a class that is gone goes with all its lines, any other with all but its first
    dropped = gone.withColumn("gone", F.lit(True))
    bad = cut(several.join(dropped.withColumnRenamed("p", "first"), "first", "left").select(*same, "first", "gone"))
    hit = rows.select(*same, *_PLACE).join(_sent(bad, bad.count()), same).where(F.col("gone") | (place != F.col("first")))
    hit = hit.select(*_PLACE).union(gone.select("p.*"))
    found = cut(hit.groupBy("k1", "k2").agg(F.collect_set("line").alias("lines")))
    release(several, met, rows, crowd, pairs, sets, live, *([] if more is None else [more, earlier]))
    return found


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``df`` with ``text`` cut down to its kept lines, and ``removed_lines`` (0-based places) added.

    Texts that lose no line are unchanged; a null text stays null; an empty table gives an empty
    one. Documents are ordered by id (nulls last), then by a hash of the text; ids that aren't
    numbers are ordered by a hash. Of rows that repeat an id and a text, one counts as earlier and
    the others lose every line of ``min_tokens`` words or more. Lines with fewer words, empty ones
    too, are always kept; with ``min_tokens`` 1 every line with a word takes part. Lines end at
    ``\\n``. A column ``removed_lines`` of ``df`` is replaced.
    """
    ids = df.groupBy(F.col(id_col).alias("i")).count().where("count > 1 or i is null").limit(1)
    repeated = not ids.isEmpty()
    k1 = number(df, id_col, (1 << 63) - 1)
    k2 = F.xxhash64(F.col(text), F.col(id_col).isNull()) if repeated else F.lit(0).cast("long")
    docs = df.select(k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    found = similar_lines(docs, repeated, min_tokens)
    names = [c for c in df.columns if c != "removed_lines"]
    plain = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), k1.alias("k1"), k2.alias("k2"))
    t = f"c{names.index(text)}"
    size = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    joined = plain.join(_sent(found, size), ["k1", "k2"], "left")
    if repeated:
        joined = joined.withColumn("copy", F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1")) > 1)
        own = F.expr(f"transform(filter(transform(split({t}, '\\n', -1), (s, i) -> struct(i, s)), x -> size({_hashes('x.s')}) >= {min_tokens}), x -> x.i)")
        joined = joined.withColumn("lines", F.when(F.col("copy"), own).otherwise(F.col("lines")))
    joined = joined.withColumn("lines", F.sort_array(F.coalesce("lines", F.array().cast("array<int>"))))
    kept = F.expr(f"array_join(filter(split({t}, '\\n', -1), (s, i) -> NOT array_contains(lines, i)), '\\n')")
    new = F.when(F.size("lines") == 0, F.col(t)).otherwise(kept)
    cols = [(new if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)]
    return joined.select(*cols, F.col("lines").alias("removed_lines"))


def op7_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.concat_ws(",", F.col("removed_lines").cast("array<string>")).alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line, unnest(string_split(t, chr(10))) AS s FROM d),
w AS (SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(lower(s), '[^\x20\x09-\x0D]+'))) AS ws FROM l),
e AS (SELECT doc_id, line, ws, len(ws) AS n FROM w WHERE len(ws) >= 5),
c AS (SELECT ws, n, min((doc_id, line)) AS first, row_number() OVER () AS id FROM e GROUP BY ws, n),
x AS (SELECT id, n, first, unnest(ws) AS token FROM c),
p AS (SELECT a.id, a.n, b.id AS other, b.n AS m, count(*) AS k FROM x a JOIN x b ON a.token = b.token AND b.first < a.first
      AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL),
g AS (SELECT DISTINCT id FROM p WHERE 9 * k >= 4 * (n + m)),
r AS (SELECT e.doc_id, e.line FROM e JOIN c ON e.ws = c.ws LEFT JOIN g USING (id) WHERE g.id IS NOT NULL OR (e.doc_id, e.line) <> c.first),
k AS (SELECT l.doc_id, string_agg(s, chr(10) ORDER BY l.line) FILTER (r.line IS NULL) AS kept,
             count(r.line)::BIGINT AS n_removed, coalesce(string_agg(l.line::VARCHAR, ',' ORDER BY l.line) FILTER (r.line IS NOT NULL), '') AS removed_lines
      FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.line = r.line GROUP BY l.doc_id)
SELECT doc_id, n_removed, removed_lines, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
