"""streaming of the lexicon engine."""
