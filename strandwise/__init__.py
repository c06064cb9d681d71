"""Sequence polishing and alignment analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to the executors whole, so that these need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
