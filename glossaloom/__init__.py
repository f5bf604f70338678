"""Text labelling on Spark: extraction, rules, training sets, classifiers, datasets."""

import sys

from pyspark import cloudpickle

# Functions of this package go to executors by value, so that they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
