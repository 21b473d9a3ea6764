"""linkledger: PySpark operators that tie measurement files to metadata records and model elements."""

import sys

from pyspark import cloudpickle

from linkledger.session import configure, get_session

# Functions sent to executors travel by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure", "get_session"]
