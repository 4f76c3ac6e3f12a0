"""Sending this package's functions to executors that don't have it installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__package__])
