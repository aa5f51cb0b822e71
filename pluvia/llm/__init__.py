"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions of this subpackage travel to the executors by value, so a session needs no ``--py-files`` for them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
