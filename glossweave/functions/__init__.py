"""functions of the lexicon engine."""
