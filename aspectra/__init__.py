"""aspectra — aspect-level opinion analytics as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function, so pipelines are chained lazily with ``DataFrame.transform`` and
planned as a whole by Catalyst.
"""

import sys as _sys

# Python functions shipped to executors (the NFKD pandas UDF, mapInPandas
# scorers) are pickled by value, so workers need no copy of this package on
# their path.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

from aspectra.session import get_spark, scratch_path  # noqa: E402

__all__ = ["get_spark", "scratch_path"]
