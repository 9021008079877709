"""Operators for preparing training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
