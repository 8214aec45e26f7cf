"""Training-data operators.  Nothing else in the library imports this package.

Functions sent to Python workers travel by value, so the workers need not have
this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
