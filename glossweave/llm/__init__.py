"""Training-data operators: encoding, dedup, language, quality, HTML, packing, sharding, LM scores, search."""
