"""Operators for preparing training text; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions are shipped with the helpers they use.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
