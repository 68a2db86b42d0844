"""Training-data operators: deduplication, packing, language id, PII, secrets, search, tokenising, toxicity.

Nothing outside this folder imports it. ``entry`` registers one query per operator.
"""
