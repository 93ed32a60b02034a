"""Operators for preparing training corpora: deduplication, filters, formatting, tokenising, sharding and mixing."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors whole, so those need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
