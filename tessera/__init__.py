"""tessera — survey profiling and segmentation as Spark DataFrame operators.

Sub-packages:

* ``sources``   – table loading, stage sinks, fitted-parameter tables
* ``functions`` – column-expression builders (text cleaning, statistics)
* ``operators`` – the generic DataFrame operators (quality, encode, profile,
  ranks, latent, segment, validate)
* ``plans``     – proxy tables over the test data, end-to-end flows and the
  query catalogue used by ``__spark_entry__``
* ``streaming`` – applying the row-local operators to streaming DataFrames
"""

import sys as _sys

from tessera.session import get_session, ensure_checkpoint_dir

# Python tasks (pandas UDFs, mapInPandas) carry the few library functions they
# call by value, so executors do not need this package installed.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["get_session", "ensure_checkpoint_dir"]
