"""Spark-first analytics over app feedback tables, and text-corpus operators beside it."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
