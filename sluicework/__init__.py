"""Event-time and changelog analytics expressed as ordinary Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Handlers and helpers reach the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
