"""Operators for preparing training text.  Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Task code travels with its tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules["dwellpath"])
