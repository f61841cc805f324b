"""Operators of a training-data pipeline: language ID, deduplication, exact
search, decontamination, toxicity, packing, secrets, token counts and chat
formatting.  Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
