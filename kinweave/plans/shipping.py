"""Batch functions travel to Python workers by value, so executors need no copy of this package."""

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
