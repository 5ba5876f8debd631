"""chainlens — supply-chain analytics as lazy Spark DataFrame transformations.

Every analysis is a function ``DataFrame -> DataFrame`` built from Spark SQL's
own expressions: no Python UDFs, no driver-side loops, no ``collect()`` inside
an operator.  Sub-packages:

* ``sources``   — typed readers (CSV / JSON documents / Parquet), sinks, and
                   adapters that expose the driver's test tables as domain views.
* ``functions`` — column-level helpers: rounding, safe ratios, RAG classifiers,
                   date helpers, distributed prefix sums and exact quantiles.
* ``operators`` — the analyses themselves, one module per subject area.
* ``plans``     — the registry of named queries and their DuckDB oracle SQL.
* ``streaming`` — the event-document analyses over a Structured Streaming source.
"""

__version__ = "0.1.0"
