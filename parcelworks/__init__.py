"""Raster tiling, mask analytics, detection clean-up and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so these need not find the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
