"""Wrenfield: an advert and school-record analytics engine built on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: what Python workers run is sent to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
