"""Operators for large-scale training-data preparation.

One module per operator; ``queries`` holds the registered queries and their SQL.
Nothing outside this subpackage (and ``corpus_pipeline``) imports it.
"""
