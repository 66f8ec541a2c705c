"""Operators of a training-data pipeline: filtering, deduplication, decontamination, formatting and mixing."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
