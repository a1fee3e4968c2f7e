"""Training-data operators: language ID, mixing, near-duplicates, PII, tokenizers, search, chat and HTML.

Nothing outside this package imports it; queries are registered in ``queries.py``.
"""
