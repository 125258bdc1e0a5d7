"""Curation and evaluation of small indexed-colour images, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run in tasks travel with the plan, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
