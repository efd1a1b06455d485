"""docspark: Spark jobs for document retrieval and training-data preparation over whole corpora.

Functions that run in tasks are pickled by value, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
