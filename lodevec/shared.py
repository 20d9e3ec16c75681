"""The folder that driver and executors share, and shipping this package to the executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where that is unset, one is made on this machine, which only a
    local master can share with its executors; for any other it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodevec-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        _made.append((spark, root))
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/lodevec/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def hadoop(spark: SparkSession, path: str):
    """Spark's own file system for a path, and the path in its terms: works on any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    store, at = hadoop(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def removed(spark: SparkSession, path: str) -> None:
    store, at = hadoop(spark, path)
    store.delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        if path.startswith(("file:/", "/")):
            shutil.rmtree(local(path), ignore_errors=True)
            continue
        try:
            removed(spark, path)
        except Exception:  # Spark has ended, or the store can't be reached
            return


def local(path: str) -> str:
    return "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else os.path.abspath(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark application: their machines need not have it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="lodevec-ship-")
    path = f"{folder}/lodevec.zip"
    copy = shutil.copytree(os.path.dirname(os.path.abspath(__file__)), f"{folder}/lodevec", ignore=shutil.ignore_patterns("__pycache__"))
    with zipfile.PyZipFile(path, "w") as z:  # compiled, so that workers don't have to
        z.writepy(copy)
    context.addPyFile(path)  # the driver serves it
    _made.append((spark, f"file://{folder}"))
    _shipped.add(context.applicationId)
