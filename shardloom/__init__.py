"""Shard planning, sample delivery and run telemetry as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers by value, so executors need no copy of
# this package, whatever folder the driver was started in.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
