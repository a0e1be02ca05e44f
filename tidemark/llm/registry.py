"""The queries of this folder: one per operator, run over whole tables."""

from __future__ import annotations

from functools import wraps

from ..shipping import ship
from . import bpe, classifier, lines, neighbours, packing, quality, simhash, suffix, urlfilter, warc


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    q.__name__: _shipped(q)
    for q in (
        packing.op1_packing,
        classifier.op2_classifier,
        warc.op3_warc,
        urlfilter.op4_urls,
        suffix.op5_suffix,
        neighbours.op6_neighbours,
        lines.op7_lines,
        bpe.op8_bpe,
        simhash.op9_simhash,
        quality.op10_quality,
    )
}

ORACLES = {
    "op3_warc": warc.OP3_SQL,
    "op4_urls": urlfilter.OP4_SQL,
    "op7_lines": lines.OP7_SQL,
    "op10_quality": quality.OP10_SQL,
}
