"""Operators of a training-data pipeline: cleaning, deduplication, scoring, encoding, formatting.

The functions that run inside tasks travel by value, so executors need the libraries they use but
not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
