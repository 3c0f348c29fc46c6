"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions of the subpackage travel to the executors by value, which need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
