"""Operators for large training-data pipelines. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Tasks get these functions by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
