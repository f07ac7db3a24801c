"""Operators of a training-data pipeline; nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# executors get the functions of this subpackage with the job, not from a path of their own
cloudpickle.register_pickle_by_value(sys.modules[__name__])
