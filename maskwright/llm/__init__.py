"""Training-data pipeline operators (nothing else in the package imports this one)."""

import sys

from pyspark import cloudpickle

# Executors get the functions' code with the tasks, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])
