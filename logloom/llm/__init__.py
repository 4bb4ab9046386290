"""Operators for building training corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Executors get the functions that run on them with the task, so the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
