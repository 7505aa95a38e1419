"""Page-photo analytics as Spark jobs: catalogue, change stream, grid analytics, match graph and evaluation."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
