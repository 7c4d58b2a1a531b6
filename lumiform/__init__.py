"""Lumiform: serialisation-robustness analytics and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
