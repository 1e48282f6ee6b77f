"""Operators for preparing training corpora: near-duplicates, search, scans, classifiers, mixing, tokens.

Functions that run in Python workers travel with their tasks, so that workers need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
