"""Operators for preparing large text corpora for model training.

Every operator takes and returns DataFrames.  The functions that run inside
Python tasks are shipped to the executors by value, so the executors need only
the third-party libraries (numpy, pyarrow, ...), not this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
