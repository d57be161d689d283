"""lumenframe: timestamped-metric, media-metadata and text analytics on PySpark.

Functions that run in Python workers are pickled by value, so executors need
none of this package's files.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
