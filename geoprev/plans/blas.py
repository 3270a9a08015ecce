"""One BLAS thread a Python worker: Spark's tasks are the parallelism, and threads of many workers would fight for the cores."""

from __future__ import annotations

import ctypes
import functools
import glob
import os

import numpy as np

SETTERS = ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_")


@functools.cache
def one_thread() -> bool:
    """Tell the OpenBLAS that NumPy brings to use one thread; False where NumPy has another library."""
    done = False
    for path in glob.glob(os.path.join(os.path.dirname(np.__path__[0]), "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in SETTERS:
            if hasattr(library, name):
                getattr(library, name)(1)
                done = True
    return done
