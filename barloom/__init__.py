"""barloom: market-structure analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for Python workers travel with the query, so executors needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
