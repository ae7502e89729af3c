"""Training-data operators. Nothing outside this subpackage imports it.

Each module holds one operator with a general interface and a thin ``query``
that applies it to a whole table; ``registry`` lists the queries and their SQL.
"""

import sys

from pyspark import cloudpickle

# executors get the functions themselves, so they need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
