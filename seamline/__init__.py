"""Composite-index analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Helpers that run inside Python workers travel with the task, so executors do
# not need this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
