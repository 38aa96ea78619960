"""Training-data operators: quality, language, near-duplicates, PII, URLs, packing, HTML."""
