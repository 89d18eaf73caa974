"""The package itself, for the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    home = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, home, True)
    kept = os.path.join(home, f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(kept, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in os.walk(package):
            for path in (os.path.join(top, n) for n in names if n.endswith(".py")):
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(kept)
    _shipped.add(sc.applicationId)
