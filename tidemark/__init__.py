"""Tidemark: event-study, entity, decision and text analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to executors inside their jobs, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
