"""Genotype cohort analytics and corpus preparation on Spark DataFrames.

Worker functions travel to the executors by value, so a cluster need not have
this package installed on every node.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
