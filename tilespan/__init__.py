"""Interval-annotation analytics on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to executors by value, which need not have it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
