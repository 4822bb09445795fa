"""DataFrame operators for collections of short, keyed time series on Spark."""

import sys

from pyspark import cloudpickle

from cyclograin.schema import clean_numeric, require_columns, session

__all__ = ["clean_numeric", "require_columns", "session"]

# ship the package's own functions with each job, so executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
