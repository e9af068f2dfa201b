"""Record analytics for reinforcement-learning and language-model data, as Spark DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions that tasks run are sent whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
