"""Operators for preparing large training corpora, each a function over DataFrames.

Nothing else in the library imports this subpackage. Functions that run inside Spark tasks are
pickled by value, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
