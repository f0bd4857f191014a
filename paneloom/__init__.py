"""Entity x period panel measurement on Spark DataFrames.

Three-valued outcomes run through every operator: a missing record is unknown, never a negative.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the query, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
