"""corpuskit: text-corpus analytics as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel by value, so that
# executors need no copy of the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
