"""tidelog: analytics over append-only event logs, expressed in DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Python functions run on executors are shipped by value, so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
