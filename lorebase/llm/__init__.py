"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers are shipped by value, so executors need numpy, pyarrow, pandas
and xxhash but no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
