"""Operators of a training-data pipeline over the ``documents`` table.

Nothing outside this subpackage imports it; ``strata.llm.queries`` holds the
registered queries and their SQL.
"""
