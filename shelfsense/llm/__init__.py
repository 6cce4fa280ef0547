"""Operators of a training-data pipeline.

Functions of this package that run inside Python workers are sent by value, so executors need
no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
