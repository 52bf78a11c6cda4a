"""Operators for large text corpora: packing, language identification, web
archives, near-duplicate and substring removal, quality rules, tokenisation,
secret scans, nearest neighbours and token files.

Nothing outside this subpackage imports it. Every operator takes and returns
Spark DataFrames; per-row work runs in Arrow batches inside tasks.
"""
