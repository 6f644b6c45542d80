"""Operators for training-data pipelines: ten operators, their queries and SQL checks.

Nothing else in the library imports this package. Functions that run in Python workers
travel with their code, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
