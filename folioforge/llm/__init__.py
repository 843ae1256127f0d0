"""Training-data operators: deduplication, sharding, language, tokens, packing.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the digest queries that are registered for checking live in
:mod:`folioforge.llm.queries`.
"""
