"""Quillon: Spark-native multi-resolution analysis of large sparse matrices, graphs and text."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

#: Functions of this package travel to executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
