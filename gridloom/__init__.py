"""gridloom: tiled-raster dataset preparation and evaluation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
