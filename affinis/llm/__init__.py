"""Operators for training-data pipelines; nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# tasks get this package's functions by value, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
