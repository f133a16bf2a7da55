"""saleslens: sales-transaction audit, correction and decision analytics on Spark.

Every operator takes and returns Spark DataFrames, names its input columns
through keyword arguments, and uses native Spark SQL functions only, so the
work runs in whole-stage codegen on the executors.

Sub-packages:

* ``sources``   - schema, CSV landing with rejects, sinks, test-table fixtures
* ``functions`` - column expressions shared by operators (ratios, flags, formats)
* ``operators`` - profiling, hierarchy audit, corrections, gates, reporting marts
* ``plans``     - end-to-end pipeline and plan-inspection helpers
* ``streaming`` - incremental CSV landing with Structured Streaming
"""

from saleslens.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
