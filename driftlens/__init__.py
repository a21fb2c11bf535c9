"""driftlens: behavioural dependency-diff analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel with the plan, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
