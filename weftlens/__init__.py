"""Fibre-image analytics over Spark DataFrames: images are rows, rasters are (image_id, y, x, value) tables."""

import sys

from pyspark import cloudpickle

# functions that go to Python workers carry their code along, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
