"""Tracking, similarity, sketch and data-cleaning operators on Spark DataFrames.

Every operator is a plain function from DataFrames to a DataFrame.  Python
kernels of the package are pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
