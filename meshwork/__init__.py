"""meshwork: governed data products on Spark.

Every operator is a lazy function from DataFrames to a DataFrame built from
``pyspark.sql.functions`` only, so the same code runs on a laptop and on a
large cluster. Sub-packages:

* ``sources``    read, discover, publish and write products
* ``operators``  profiling, contracts, quality, governance, semantics,
                 catalog, property graph, graph queries, lineage
* ``functions``  column-level expression helpers (text rules, scoring)
* ``plans``      session set-up, seed tables, derived views, the query suite
* ``streaming``  the append-only logs as Structured Streaming jobs
"""

__version__ = "0.1.0"
