"""inkflow: a Spark-native engine for document-text pipelines."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Worker processes receive the functions themselves, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
