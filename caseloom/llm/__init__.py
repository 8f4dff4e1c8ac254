"""Operators of a training-data pipeline, one module each.

Nothing else in the library imports this package; its queries and SQL are
in ``caseloom.llm.queries``.  Functions that run inside Python workers are
shipped by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
