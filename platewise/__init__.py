"""Spark-native recipe and nutrition analytics."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
