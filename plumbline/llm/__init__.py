"""Operations of a training-data pipeline over tables of documents. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions travel to the executors whole, so these need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
