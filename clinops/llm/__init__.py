"""Training-data operators: text, vector and web-page jobs over the corpus tables.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
