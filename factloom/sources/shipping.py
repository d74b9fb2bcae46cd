"""Send the package to the executors once per application."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{name}_sources_{app}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(target)
    _DONE.add(app)
