"""Where intermediate tables are written."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Folders of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for written intermediate tables.

    It is the session's ``spark.checkpoint.dir``. Only a local session may do
    without: there a temporary folder is every task's folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="aisle-")
    return _LOCAL[app]
