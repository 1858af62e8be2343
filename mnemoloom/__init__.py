"""Retrieval, code-graph and history analytics as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel inside the job, so executors
# need numpy and pyarrow but no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
