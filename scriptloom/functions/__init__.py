"""Column functions: patterns, tokens, codecs."""
