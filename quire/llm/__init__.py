"""Training-data operators: fingerprints, token store, vector search, deduplication,
secret and personal-data scans, quality, mixing and byte-level BPE.

Nothing outside this subpackage imports it.  Its functions are pickled by value, so
executors need neither a copy of the repository nor a shared Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
