"""Operators for preparing training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# The functions that run inside tasks travel with the tasks, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
