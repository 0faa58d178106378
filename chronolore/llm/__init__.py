"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

from pyspark import cloudpickle

import chronolore

# Functions of this package travel to Python workers by value, so an executor needs no copy of the repository.
cloudpickle.register_pickle_by_value(chronolore)
