"""Quality rules with risk-controlled cutoffs, in DataFrame and SQL functions only.

Statistics of each whole text are computed inside its row, without a shuffle. Each rule rejects
texts whose statistic exceeds a cutoff. The cutoffs of all rules are tightened together in a
sequence of steps that is fixed beforehand (``STEPS``): each step lowers the cutoff of one rule,
so the rejected texts only grow. On labelled good documents of a stratum, the exact binomial tail
P(X <= k | n, risk) for the k of n that a step's rules reject, all rules together, says whether
the step's false rejection rate is surely below ``risk`` (the same decision as an exact upper
confidence bound).

Multiple testing: within a stratum the steps are tested in their order until one fails, which
needs no correction (fixed-sequence testing; the tail can't fall again, as k can't); the strata
share ``alpha`` by Bonferroni. So with probability 1 - ``alpha`` every stratum loses at most
``risk`` of its good documents to all rules together. The last step that passes is used. A stratum
with too few labels for any step (86 good ones are needed at 4 strata) has no cutoffs: its rules
are off.

Three-word windows are compared by a 64-bit hash of their words within one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACES = "' \\t\\n\\u000B\\u000C\\r'"
SYMBOLS = "#*$%&|<>"
#: rule -> (statistic, grid of cutoffs, the tightest first); a text is rejected if the statistic is above the cutoff.
RULES = {
    "symbols": ("n_symbols / n_words", (0.05, 0.1, 0.2, 0.5, 1.0)),
    "dup_lines": ("n_dup_lines / n_lines", (0.1, 0.2, 0.3, 0.5)),
    "repeats": ("n_repeat_words / n_words", (0.2, 0.3, 0.4, 0.45)),
    "long_words": ("word_chars / n_words", (7.0, 8.0, 9.0, 10.0, 12.0)),
}
#: (rule, cutoff) that each step adds: the rules in turn, from the loosest cutoff to the tightest
STEPS = [(r, cs[-1 - i]) for i in range(max(len(cs) for _, cs in RULES.values())) for r, (_, cs) in RULES.items() if i < len(cs)]
RISK = 0.05
ALPHA = 0.05
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BROADCAST_ROWS = 4_096


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) to ``df``.

    Null, empty and wordless texts have no words and zero everywhere; n_lines counts lines with
    a word. Columns of these names are replaced.
    """
    new = [*BASE, "n_lines"]
    rest = [c for c in df.columns if c not in new]
    base = df.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    bare = f"trim(BOTH {SPACES} FROM _t)"
    step = base.withColumns(
        {
            "_w": F.expr(f"IF({bare} = '', array(), split({bare}, '[\\\\x20\\\\x09-\\\\x0D]+'))"),
            "word_chars": F.expr(f"length(translate(_t, {SPACES}, ''))").cast("long"),
            "n_symbols": F.expr(f"length(_t) - length(translate(_t, '{SYMBOLS}', ''))").cast("long"),
            "_l": F.expr("filter(split(_t, '\\n', -1), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"),
        }
    ).drop("_t")
    step = step.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_g": F.expr("IF(size(_w) < 3, array(), transform(sequence(0, size(_w) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))))"),
        }
    ).drop("_w", "_l")
    # windows in order of hash and place; only texts that have a repeated window are sorted
    step = step.withColumn(
        "_s", F.expr("IF(size(array_distinct(_g)) = size(_g), array(), array_sort(transform(_g, (h, i) -> struct(h as h, i as i))))")
    ).drop("_g")
    step = step.withColumn(
        "_p", F.expr("array_sort(transform(filter(_s, (x, j) -> x.h <=> get(_s, j - 1).h OR x.h <=> get(_s, j + 1).h), x -> x.i))")
    ).drop("_s")
    step = step.withColumn(
        "n_repeat_words",
        F.expr("aggregate(transform(_p, (p, j) -> least(3, coalesce(get(_p, j + 1), p + 3) - p)), 0L, (a, x) -> a + x)"),
    ).drop("_p")
    return step.select(*(F.col(f"`{c}`") for c in rest), *new)


def _tail(k: str, n: str, risk: float) -> str:
    """SQL for P(X <= k), X binomial (n, risk); 1 where k is above the mean, which never passes."""
    log_pass = f"ln({1 - risk!r}D)"
    odds = f"ln({risk!r}D / {1 - risk!r}D)"
    return f"""IF({k} > {n} * {risk!r}D, 1D, aggregate(
        IF({k} > 0, sequence(0L, {k} - 1), array()),
        named_struct('lp', {n} * {log_pass}, 'c', exp({n} * {log_pass})),
        (s, j) -> named_struct('lp', s.lp + ln(({n} - j) / (j + 1)) + {odds},
                               'c', s.c + exp(s.lp + ln(({n} - j) / (j + 1)) + {odds})),
        s -> s.c))"""


def _value(rule: str) -> str:
    """SQL of a rule's statistic; 0 without a denominator."""
    statistic = RULES[rule][0]
    return f"IF({statistic.split(' / ')[1]} = 0, 0D, {statistic})"


def cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """(stratum, cut_<rule>...) for each stratum where a step passes; null cutoffs are rules that are off.

    Good is a labelled id whose rows all say quality 1 and toxic 0.
    """
    good = labels.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).where("good").select("doc_id")
    hits = [F.when(F.expr(_value(r)) > F.lit(float(c)), F.lit(t)) for t, (r, c) in enumerate(STEPS)]
    step = F.least(*hits)  # the first that rejects the text
    lost = F.array(*(F.struct(F.lit(t).alias("step"), F.sum((F.coalesce("_step", F.lit(len(STEPS))) <= t).cast("long")).alias("k")) for t in range(len(STEPS))))
    tests = stats.join(good, "doc_id").withColumn("_step", step).groupBy(stratum).agg(F.count("*").alias("n"), lost.alias("_t"))
    tests = cut(tests)
    strata = max(1, tests.count())
    passed = tests.select(stratum, "n", F.explode("_t").alias("_t")).select(stratum, "n", "_t.*").where(F.expr(_tail("k", "n", risk)) <= alpha / strata)
    last = passed.groupBy(stratum).agg(F.max("step").alias("_last"))
    used = {r: [t for t, (x, _) in enumerate(STEPS) if x == r] for r in RULES}
    cuts = [F.least(*(F.when(F.col("_last") >= t, F.lit(float(STEPS[t][1]))) for t in used[r])).alias(f"cut_{r}") for r in RULES]
    return last.select(stratum, *cuts)


def apply_rules(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, statistics, base_failed, kept): one row for each row of ``docs``.

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows. A
    null stratum is a stratum of its own. Null ids are judged but never count as labelled. Repeated
    rows are judged, and count, each. Without rows, or without labels, no rule but the base is on.
    """
    stats = cut(statistics(docs.select("doc_id", F.col(stratum).alias("stratum"), F.col(text).alias("text")), "text").drop("text"))
    cuts = cut(cutoffs(stats, labels, "stratum").withColumnRenamed("stratum", "_stratum"))
    side = F.broadcast(cuts) if cuts.count() <= _BROADCAST_ROWS else cuts
    joined = stats.join(side, F.col("stratum").eqNullSafe(F.col("_stratum")), "left").drop("_stratum")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = [F.coalesce(F.expr(_value(r)) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    rejected = over[0]
    for o in over[1:]:
        rejected = rejected | o
    return joined.select(
        "doc_id", F.col("stratum").alias(stratum), *BASE, "n_lines", failed.alias("base_failed"), (~failed & ~rejected).alias("kept")
    )


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", *BASE, "base_failed", "kept")


def _oracle() -> str:
    plain = {r: f"(CASE WHEN {e.split(' / ')[1]} = 0 THEN 0 ELSE {e} END)" for r, (e, _) in RULES.items()}
    step = "least(" + ", ".join(f"CASE WHEN {plain[r]} > {float(c)!r} THEN {t} END" for t, (r, c) in enumerate(STEPS)) + ")"
    cuts = {r: "least(" + ", ".join(f"CASE WHEN last >= {t} THEN {float(c)!r} END" for t, (x, c) in enumerate(STEPS) if x == r) + ")" for r in RULES}
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT rid, unnest(range(len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT rid, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS gram FROM g),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM h) WHERE c > 1),
rw AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
l AS (SELECT rid, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
s AS (
  SELECT d.rid, doc_id, lang, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l.ls)::BIGINT AS n_lines,
         (len(l.ls) - len(list_distinct(l.ls)))::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN rw USING (rid)
), good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING bool_and(quality = 1 AND toxic = 0)),
first AS (SELECT lang, {step} AS step FROM s JOIN good USING (doc_id)),
tests AS (
  SELECT lang, t, count(*) AS n, count(*) FILTER (step <= t) AS k FROM first, (SELECT unnest(range({len(STEPS)})) AS t) GROUP BY ALL
), p AS (
  SELECT lang, t, CASE WHEN k > n * {RISK!r} THEN 1 ELSE list_sum(list_transform(range(k + 1),
         lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK!r}) + (n - j) * ln({1 - RISK!r})))) END AS tail FROM tests
), last AS (SELECT lang, max(t) AS last FROM p WHERE tail <= {ALPHA!r} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM first)) GROUP BY lang),
cuts AS (SELECT lang, {", ".join(f"{cuts[r]} AS cut_{r}" for r in RULES)} FROM last),
j AS (SELECT s.*, cuts.* EXCLUDE (lang), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
      FROM s LEFT JOIN cuts ON s.lang IS NOT DISTINCT FROM cuts.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"coalesce({plain[r]} > cut_{r}, false)" for r in RULES)}) AS kept
FROM j
"""


OP10_SQL = _oracle()
