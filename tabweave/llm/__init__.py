"""Operators that prepare text corpora for training, each a distributed Spark job.

Nothing else in the library imports this subpackage.  Functions that run inside
Python workers are pickled by value, so a worker does not need the package on its
own import path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
