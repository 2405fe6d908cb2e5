"""Operators of a training-data pipeline over documents, pages and benchmarks.

Nothing outside this package imports it; ``queries.py`` holds the registered queries.
Task functions travel by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
