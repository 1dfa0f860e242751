"""Training-data operators: packing, search, language, privacy, tokens, duplicates, toxicity, LM, URLs.

Every operator takes and returns DataFrames. Nothing outside this subpackage (and
``corpus_pipeline.py``) imports it.
"""
