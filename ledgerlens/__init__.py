"""Profiling of labelled transaction tables on Spark."""

import sys

from pyspark import cloudpickle

# Python tasks carry their helper functions along, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
