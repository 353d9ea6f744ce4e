"""Structure analytics for captured web pages and change analytics for source code, on Spark."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors with their tasks, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
