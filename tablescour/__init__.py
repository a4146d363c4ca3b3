"""tablescour: table cleaning, validation and data-quality reports as Spark plans."""

import sys

from pyspark import cloudpickle

from tablescour.errors import CleanError

# The few functions that run in Python workers travel with their code, so the package
# need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CleanError"]
