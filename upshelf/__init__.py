"""upshelf — retail-media incrementality analytics as Spark DataFrame jobs.

Layout:
  functions/  column expressions (week anchors, list parsing, node keys, safe maths)
  sources/    readers, sinks, canonical schemas and the driver-table adapters
  operators/  composite operators: DataFrame(s) -> DataFrame, no actions inside
  plans/      query catalogue (``queries()``) and DuckDB oracle SQL
"""

__version__ = "0.1.0"
