"""Labelled, timestamped text as data, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel whole, so executors do not need the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
