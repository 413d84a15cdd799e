"""kilnlog: Spark-native analytics over ordered logs and text tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster
# needs no copy of it on the workers' Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
