"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; ``queries.py`` binds the operators to the tables as registered queries.
"""
