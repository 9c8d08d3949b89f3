"""offerlake: peer-to-peer trade offer analytics on Spark DataFrames.

Sub-packages:

* ``sources``   - readers, writers and the test-data fixtures.
* ``functions`` - column-level helpers (time differences, labels, fees, ids).
* ``operators`` - DataFrame -> DataFrame operators (reports, lookups, lifecycle,
  pricing, payments, feed, audit, change joins).
* ``plans``     - composed jobs (start-up sweep, report document) and the query
  catalogue used by ``__spark_entry__``.
* ``streaming`` - Structured Streaming versions of the operators.
"""

import sys as _sys

from offerlake.session import get_spark, checkpoint_dir  # noqa: F401

# Python functions that run in Spark's Python workers (the streamed replay
# fold, the per-offer timers) are shipped by value, with the offerlake
# modules they use, so workers need no installed copy of this package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with addPyFile instead
    pass
