"""Files of our own formats in the cluster's shared folder, written and read by tasks.

Each attempt of a task writes files of its own names; the rows it returns name them. Those rows are stored,
so that only the files of the attempts that Spark accepted are ever read.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import SparkSession

from chronoscribe.session import scratch, uri


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``; ``session.remove_stored`` deletes it with the stored tables."""
    return uri(scratch(spark, name))


def own_name() -> tuple[int, str]:
    """This task's partition and a file name that no other attempt has."""
    task = TaskContext.get()
    return task.partitionId(), f"{task.partitionId():06d}-{task.taskAttemptId()}"


def opened(folder: str):
    """The file system of a URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def for_writing(folder: str):
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return system, path
