"""Training-data operators: quality, decontamination, search, token counts, toxicity, licences, BPE, URLs, language, near-duplicates.

Nothing outside this subpackage imports it.
"""
