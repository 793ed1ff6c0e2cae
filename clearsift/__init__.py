"""clearsift: document screening, retrieval and corpus building on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in the executors' Python travel with the job, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
