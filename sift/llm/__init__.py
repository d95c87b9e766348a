"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it can be imported.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value: a worker needs no copy of this repository on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
