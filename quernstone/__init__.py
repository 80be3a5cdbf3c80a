"""Quernstone: evidence analytics and corpus processing as DataFrame-to-DataFrame operators on Spark."""
import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
