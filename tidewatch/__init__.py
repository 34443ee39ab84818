"""tidewatch: time-windowed log analytics and outlier detection on PySpark.

Every operator is a plain ``DataFrame -> DataFrame`` function.  Batch and
Structured Streaming share the same feature code; they differ only in source,
watermark and sink.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
