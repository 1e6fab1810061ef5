"""Operators of a training-data pipeline: scoring, tokenizing, deduplication, mixing and archives.

Nothing outside this subpackage imports it.  Each module holds one operator with its own general
interface; :mod:`strandlog.llm.queries` derives the registered ``opN_*`` queries from them.
"""
