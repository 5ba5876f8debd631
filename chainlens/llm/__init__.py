"""Training-data operators: deduplication, archives, tokens, filters, mixing.

Each module holds one operator with a general interface (column names and
parameters are arguments).  :mod:`chainlens.llm.queries` binds them to the
test tables.  Nothing outside this package imports it.
"""
