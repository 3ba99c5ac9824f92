"""Operators of a training-data pipeline; nothing else in the library imports this package.

Functions of this package that run inside tasks are shipped by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
