"""Training-data operators: de-duplication, extraction, classification, packing, mixing, search.

Functions that run on executors are shipped by value, so an executor needs Python and numpy but no
copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
