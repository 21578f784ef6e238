"""Feature tables from reports, and models on them, as Spark jobs."""

import sys

from pyspark import cloudpickle

# task functions travel whole, so that workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
