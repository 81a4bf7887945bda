"""Operators for preparing language-model training data; ``queries`` registers them."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so a worker needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
