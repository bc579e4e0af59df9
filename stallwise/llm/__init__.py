"""Operators of a training-data pipeline.

Their Python functions are shipped to the executors by value, so no copy of the library has
to be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
