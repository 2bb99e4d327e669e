"""A knowledge engine for governed documents, as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the task: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
