"""Operators of a training-data pipeline over documents, pages and messages.

Nothing outside this package imports it. Its functions travel to the Python
workers by value, so executors need the third-party packages but not this one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
