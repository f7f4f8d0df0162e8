"""Tessera: hybrid retrieval and text-corpus jobs as Spark DataFrame plans."""
