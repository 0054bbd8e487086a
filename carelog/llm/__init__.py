"""Operators of a training-data pipeline (one module per operator).

Nothing outside this subpackage imports it.  Functions that run on executors
travel by value, so a worker needs no copy of the package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
