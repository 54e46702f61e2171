"""Make Python code used inside Spark tasks importable on executors."""

from __future__ import annotations

import sys
import types

from pyspark import cloudpickle


def ship_by_value(module: types.ModuleType | str) -> None:
    """Pickle functions of ``module`` by value when they are sent to tasks."""
    mod = sys.modules[module] if isinstance(module, str) else module
    try:
        cloudpickle.register_pickle_by_value(mod)
    except ValueError:  # already registered
        pass
