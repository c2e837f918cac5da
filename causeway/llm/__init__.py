"""Operators for preparing training data."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions of this subpackage go to the executors by value, so they need no copy of it there.
register_pickle_by_value(sys.modules[__name__])
