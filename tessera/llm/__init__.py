"""Operators for building training data: quality scores, licence scans, page
text, source mixing, near-duplicates, tokenisation, line deduplication,
language identification, nearest neighbours and document fingerprints."""
