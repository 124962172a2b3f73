"""precedent: similar-case retrieval and recommendation on Spark."""

import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle

    # Functions and classes of this package (Arrow/pandas UDF bodies, the
    # hashing encoder, the XLSX parser) travel inside the task by value, so
    # executors need no copy of the package on their Python path.
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - pyspark missing or an older cloudpickle
    pass
