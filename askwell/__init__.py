"""askwell: a Spark engine for the data side of asking a warehouse questions in plain language."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in tasks travel with the job, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
