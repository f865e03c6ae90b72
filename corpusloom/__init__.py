"""Corpus preparation and hybrid retrieval as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the Python workers by value, so that it
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
