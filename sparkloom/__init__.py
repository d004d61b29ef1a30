"""Spark-first engine for turning feeds, pages and dialogue into graded lessons."""

import sys

from pyspark import cloudpickle

# Functions run on executors travel by value, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
