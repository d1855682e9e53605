"""Column functions: normalisation, parsing and similarity."""

import sys

from pyspark import cloudpickle

# Executors get these functions with the job; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
