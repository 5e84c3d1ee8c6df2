"""Flight-performance analytics on Spark: sources, operators, streaming twins and sinks."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value: these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
