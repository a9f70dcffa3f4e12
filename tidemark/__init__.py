"""Customer-risk analytics on Spark: lazy DataFrame operators over customer tables and event logs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

#: Executors get this package's functions by value and need no copy of it.  For that, what runs there uses names
#: imported from modules of the package, never the modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
