"""panelstat: panel-decision analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from panelstat.schema import ATTRIBUTES, CONSENSUS, HUMAN_PREFIX

# Functions that run in tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ATTRIBUTES", "CONSENSUS", "HUMAN_PREFIX"]
