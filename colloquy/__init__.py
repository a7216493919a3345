"""Conversation-data preparation, retrieval and workflow scoring as Spark jobs.

The package's functions that run inside Python workers are pickled by value,
so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
