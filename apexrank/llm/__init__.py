"""Operators of a training-data pipeline over the text tables. Nothing else in the library imports this subpackage.

The numpy kernels are shipped to the executors by value, so they need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
