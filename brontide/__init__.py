"""Catalog analytics and training-data operators on Spark: functions from DataFrame to DataFrame."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
