"""Spark-native analytics for large tables of geolocated, categorised sites."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code: workers need not find this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
