"""Operators for training-data pipelines; nothing else in the library imports this subpackage.

Functions that run inside tasks are pickled by value, so executors need numpy and pyarrow
but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
