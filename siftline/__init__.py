"""Spark jobs for AI-traffic governance, audit analytics and corpus preparation."""

import sys

from pyspark import cloudpickle

# Helpers that run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
