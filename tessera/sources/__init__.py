"""Sources: files to index, and the tables of retrieval benchmarks."""
