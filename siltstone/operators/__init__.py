"""Operators over the knowledge store's tables; each takes DataFrames and returns a DataFrame."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
