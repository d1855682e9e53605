"""Training-data operators: text extraction, deduplication, filtering, scoring and mixing.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Executors get these functions with the job; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
