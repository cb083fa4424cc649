"""Training-data operators on Spark: search, packing, deduplication, tokens, chat, classifiers."""
