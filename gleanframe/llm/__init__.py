"""Operators for training-data pipelines; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# The kernels travel with the task; workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])
