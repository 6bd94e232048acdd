"""Operators of a training-data pipeline: one module per operator.

Functions of this package that run inside tasks are pickled by value, so the
executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
