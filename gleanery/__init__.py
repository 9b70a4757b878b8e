"""Document retrieval and memory analytics as lazy Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
