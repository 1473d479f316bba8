"""Training-data operators: fingerprints, sharding, quality rules, mixing,
deduplication, toxicity, packing, language-model scoring, similarity joins
and secret scans. Nothing outside this subpackage imports it."""
