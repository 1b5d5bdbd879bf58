"""Log analytics on Spark: logs, vectors, alerts, reports, metric samples and transcripts as DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
