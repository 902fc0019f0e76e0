"""Entity-level web-text classification and text drift on Spark."""

import sys

from pyspark import cloudpickle

# Python functions that run in tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
