"""graphloom: a typed code knowledge graph kept as Spark tables.

Sub-packages: ``sources`` (file scans, store tables, fixture views),
``operators`` (traversal, search, communities, corrections, ledger, gaps),
``functions`` (column expressions), ``plans`` (registered queries and their
SQL oracles) and ``streaming`` (incremental corrections and ingestion).
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions of the package that run inside tasks are pickled by value, so the
# executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
