"""Scholarly-graph analytics on Spark: every operator is a function from DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors by value, so that a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
