"""Temporal knowledge analytics over conversations and documents, on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so an executor needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
