"""Windowed analytics over many long time series, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers travel by value, so a
# cluster needs no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
