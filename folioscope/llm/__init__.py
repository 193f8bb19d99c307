"""Training-data operators: tokenising, quality rules, language-model scoring, deduplication,
sharding, secret scans, similarity joins, WARC normalising, vector search, source mixing, hard negatives,
whitening and near-duplicate vectors.

Nothing outside this subpackage imports it. ``registry`` holds the queries and their SQL.
"""
