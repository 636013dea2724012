"""Spark-native analytics over ordered, typed streams: encodings, profiles, plans and codecs."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
