"""Operators for training-data pipelines: search, cleaning, tokenising, packing, archives.

Nothing outside this subpackage imports it.
"""
