"""Tessitura: symbolic-music analytics as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to executors with their code, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
