"""Output-grounded equivalence analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

#: Functions that run on executors travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
