"""Operators for training-data pipelines over document, conversation and benchmark tables.

Nothing outside this subpackage imports it. Its functions travel to the executors by value, so a cluster needs no
installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
