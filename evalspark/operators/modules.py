"""Scorers from a file that is not on the Python path."""

from __future__ import annotations

import importlib.util
import os
import sys
import warnings

from pyspark.sql import SparkSession

from evalspark.operators.scoring import registered, restore


def load_scorers(spark: SparkSession, path: str) -> list[str]:
    """Import a Python file whose code registers scorers, and ship it to the executors.

    Returns the names it registered. A file that is missing or fails to import warns, registers
    nothing and ships nothing. The file is known by its name, here and on the executors, where its
    functions are imported from the shipped copy; so a changed file needs a new name in a running session.
    What the file imports, this package included, must be installed on the executors.
    """
    name = os.path.splitext(os.path.basename(path))[0]
    if not os.path.isfile(path):
        warnings.warn(f"scorer module not found: {path}", stacklevel=2)
        return []
    known = importlib.util.find_spec(name) if name not in sys.modules else sys.modules[name].__spec__
    if known is not None and os.path.realpath(known.origin or "") != os.path.realpath(path):
        warnings.warn(f"a module named {name} exists already: {known.origin}", stacklevel=2)
        return []
    before = registered()
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module  # functions are pickled by this name
    try:
        spec.loader.exec_module(module)
        spark.sparkContext.addPyFile(path)
    except Exception as caught:  # foreign code
        del sys.modules[name]
        restore(before)
        warnings.warn(f"scorer module {path} failed to load: {caught}", stacklevel=2)
        return []
    after = registered()
    return sorted(n for n, s in after.items() if before.get(n) is not s)
