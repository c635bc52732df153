"""Spark-native scanning and corpus analytics."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: What the package offers by name; loaded when first asked for.
EXPORTS = {"scan": "siftspark.plans.scan", "scan_and_render": "siftspark.plans.scan", "sweep": "siftspark.plans.scan", "build_registry": "siftspark.plans.scan", "render": "siftspark.operators.report"}


def __getattr__(name: str):
    if name not in EXPORTS:
        raise AttributeError(name)
    import importlib

    return getattr(importlib.import_module(EXPORTS[name]), name)
