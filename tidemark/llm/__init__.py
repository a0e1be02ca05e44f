"""Training-data operators: packing, scoring, archives, deduplication, search, tokens.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
