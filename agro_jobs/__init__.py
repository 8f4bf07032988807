"""Spark jobs for weather readings, question logs and training text.

Functions of this package are sent to Python workers by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
