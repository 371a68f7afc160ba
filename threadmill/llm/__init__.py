"""Training-data operators: scoring, search, filtering, encoding, sharding, mixing, joins.

Functions that run in Python workers are pickled by value, so a cluster's
executors need not have this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
