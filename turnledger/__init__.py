"""Versioned conversation state and hybrid memory retrieval on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python operators travel to the executors by value, so the workers need not have this
# package installed, wherever the driver was started.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
