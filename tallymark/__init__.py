"""Spark-native indicator engine: landed tables -> long observations -> indicator marts -> chart series."""

import sys

from pyspark import cloudpickle

# the byte decoders travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
