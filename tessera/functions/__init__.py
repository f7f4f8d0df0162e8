"""Column functions: text analysis, vectors and codecs."""
