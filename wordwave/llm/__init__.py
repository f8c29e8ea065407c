"""Operators for large text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`wordwave.llm.queries` applies them to the
test tables.
"""
