"""URL allow and block lists held in a trie over reversed host labels, then path segments.

The trie is built on the driver from the given rules (a bounded list; their number and that of
the trie's nodes are checked) and broadcast. A url walks its host labels from the right; at each node that ends
some rule's host, the node's path trie is walked over whole segments, with a final partial
segment matched as a string prefix. The longest match wins: most host labels, then the
longest path. At one equal rule given both ways, block wins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: (host, path, verdict) of the registered query.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def build_trie(rules, max_rules: int = 1_000_000, max_nodes: int = 400_000) -> dict:
    """Nested dicts: host label -> node; node[""] is the path trie of the host that ends there.

    A path trie node maps a segment to its child; under the key None it has (prefix, rule,
    verdict) entries, the prefix being the rule's last, possibly partial, segment. A node takes
    some 250 bytes besides its label, so the trie is about 100 MB at most; more is an error.
    """
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the broadcast trie is bounded by {max_rules}")
    root: dict = {}
    left = max_nodes

    def child(node: dict, label: str) -> dict:
        nonlocal left
        if label not in node:
            left -= 1 + len(label) // 250
            if left < 0:
                raise ValueError(f"the broadcast trie is bounded by {max_nodes} nodes")
            node[label] = {}
        return node[label]

    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        host = host.translate(_LOWER)
        node = root
        for label in reversed(host.split(".")):
            node = child(node, label)
        here = child(node, "")
        *whole, last = path.split("/")
        for segment in whole:
            here = child(here, segment)
        ends = here.setdefault(None, [])
        if old := [e for e in ends if e[0] == last]:
            if verdict == "allow" or old[0][2] == "block":
                continue
            ends.remove(old[0])
        ends.append((last, host + path, verdict))
        ends.sort(key=lambda e: -len(e[0]))
    return root


def _longest_path(trie: dict, path: str):
    best, node, at = None, trie, 0
    while node is not None:
        rest_end = path.find("/", at)
        for prefix, rule, verdict in node.get(None, ()):
            if path.startswith(prefix, at):
                best = (rule, verdict)
                break
        if rest_end < 0:
            break
        node = node.get(path[at:rest_end])
        at = rest_end + 1
    return best


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#``; path up to ``?``, ``#``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stops = [i for c in "?#" if (i := rest.find(c)) >= 0]
    rest = rest[: min(stops)] if stops else rest
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


def judge(trie: dict, host: str, path: str):
    """The winning (rule, verdict), or None."""
    node, best = trie, None
    for label in reversed(host.split(".")):
        if not label or (node := node.get(label)) is None:
            break
        if "" in node and (hit := _longest_path(node[""], path)):
            best = hit
    return best


def filter_urls(df: DataFrame, rules=RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to ``df`` (in place of columns of these names).

    Null urls and urls without ``://`` have an empty host and path, so no rule fits and they
    get ``default``. Rows are neither dropped nor merged; an empty table gives an empty one.
    """
    bound_batches(df.sparkSession)
    if default not in ("allow", "block"):
        raise ValueError(f"default {default!r}")
    new = ["host", "path", "rule", "verdict"]
    old = [c for c in df.columns if c not in new]
    sent = df.sparkSession.sparkContext.broadcast(build_trie(rules))
    keep = [f"c{i}" for i in range(len(old))]
    plain = df.select(*(df[f"`{c}`"].alias(k) for c, k in zip(old, keep)), df[f"`{url}`"].alias("_url"))

    def run(batches):
        trie = sent.value
        for batch in batches:
            rows = []
            for u in batch.column("_url").to_pylist():
                host, path = split_url(u)
                rows.append((host, path, *(judge(trie, host, path) or (None, default))))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(c, pa.string()) for c in cols)], names=[*keep, *new]
            )

    schema = plain.drop("_url").schema
    for c in new:
        schema = schema.add(c, "string")
    return plain.mapInArrow(run, schema).toDF(*old, *new)


def op4_urls(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), r(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                           ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT h.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""
