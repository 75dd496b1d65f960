"""docket: document retrieval and question routing as Spark jobs."""

from __future__ import annotations

import os
import tempfile
import zipfile

__version__ = "0.1.0"

_SHIPPED: set[int] = set()


def ship(spark) -> None:
    """Make this package importable in the Python workers of ``spark``'s
    executors (``addPyFile`` of a zip of the package), once per context.

    The zip is a driver-side artifact that Spark's file server hands to every
    executor (as ``--py-files`` would); no task reads a driver-local folder.
    On a cluster where the package is installed or passed with ``--py-files``
    this is harmless."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="docket-pyfiles-"), "docket.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
