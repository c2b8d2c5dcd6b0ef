"""Operators for preparing language-model training data; nothing outside this folder imports it.

Functions that run inside tasks travel by value, so that executors need not have this package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
