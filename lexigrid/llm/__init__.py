"""Training-data operators: toxicity, deduplication, packing, tokenising and quality."""
