"""Operators for training corpora: deduplication, search, archives, classifiers, tokens, decontamination, secrets.

Nothing else in the library imports this package. Its functions travel to the executors by value, so they need no copy
of the library there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
