"""Sessions: defaults for local runs, and the package on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", **options) -> SparkSession:
    """A session for one machine; on a cluster the submitted configuration rules."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC")
    defaults = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "8g"}
    for key, value in (defaults | options).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so tasks can import it wherever it is installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="skein-ship-")  # the driver's own; Spark serves it to the executors
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"skein-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
