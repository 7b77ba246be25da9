"""vecatlas: an embedding catalog and similarity-search engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
