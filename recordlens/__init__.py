"""Spark jobs for evidence retrieval over record collections, and for measuring it.

Every job takes DataFrames and returns DataFrames.  Rank, position and ordinal
are columns, every ordering ends in a unique key, and the clock is a parameter.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
