"""Palisade: a Spark-native engine for audit evidence and training-data preparation.

Functions that run in Python workers are pickled by value, so executors need
no copy of this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
