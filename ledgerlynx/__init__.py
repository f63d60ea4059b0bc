"""Invoice-risk analytics on Spark: every operator takes and returns DataFrames."""

import sys

from pyspark import cloudpickle

from ledgerlynx.config import DEFAULTS, Thresholds

# Functions shipped to Python workers travel by value, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULTS", "Thresholds"]
