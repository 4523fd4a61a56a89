"""Source-code analytics on Spark: files are rows, extraction is a projection.

``operators`` take and return DataFrames, ``functions`` are column expressions,
``sources`` produce file tables, ``plans`` are whole runs and ``streaming`` works on
snapshots that keep arriving.
"""

import sys

from pyspark import cloudpickle

# Functions run on executors travel with their code: workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
