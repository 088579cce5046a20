"""Operators for preparing training data. Nothing else in the library imports this package.

Functions that run in tasks are sent whole, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
