"""The folder that the driver and all executors share, for what a job writes and reads again."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where there is none, a temporary one is set, but only for a session
    whose tasks run in the driver; on a cluster that is an error, as executors do not share their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="trivane-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """(file system, path) of a path in any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names of the files of a folder; none if there is no such folder."""
    system, place = _at(spark, folder)
    return sorted(x.getPath().getName() for x in system.listStatus(place)) if system.exists(place) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, and the folders that it is in."""
    system, place = _at(spark, path)
    system.create(place).close()


def renamed(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file or folder within a file system; its new parent is made. It is an error if something is there."""
    system, place = _at(spark, target)
    system.mkdirs(place.getParent())
    if system.exists(place) or not system.rename(_at(spark, source)[1], place):
        raise FileExistsError(f"{source} could not become {target}")


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: functions in Arrow batches need it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    work = Path(tempfile.mkdtemp(prefix="trivane-code-"))
    shutil.copytree(package, work / "code" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(str(work / "trivane_code"), "zip", work / "code")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
