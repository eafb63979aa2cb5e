"""Castwright: a PySpark-native engine for time-aligned, speaker-labelled transcripts."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with the plan, so the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
