"""Labelled-telemetry preparation, sampling, classifier evaluation and detector
comparison on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Python workers get the few vectorised helpers with the task, so the package need not be
# installed on the executors.
register_pickle_by_value(sys.modules[__name__])
