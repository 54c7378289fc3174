"""Operators for preparing training text at scale. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Code that runs in Python workers travels with the query, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
