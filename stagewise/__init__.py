"""stagewise: attrition analytics and corpus preparation on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers on a cluster need not have this package on their path:
# functions of it travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
