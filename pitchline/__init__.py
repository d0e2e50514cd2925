"""Match analytics on Spark: facts, point-in-time features, models, reports."""

import sys

from pyspark import cloudpickle

# Python workers get our functions with the task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
