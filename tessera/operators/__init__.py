"""DataFrame operators: keys, blocking, candidates, features, decisions, metrics, models."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
