"""Session settings the operators rely on."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "chronoscribe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC clock, AQE and Arrow; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPED: set[str] = set()
_STORED: dict[str, list[str]] = {}


def ship(spark: SparkSession, *files: str) -> None:
    """Send this package (and ``files``) to the Python workers, once per application.

    Not needed where the package is installed on every machine."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="chronoscribe-"), "chronoscribe.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
        for path in files:
            z.write(path, os.path.basename(path))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, which all executors reach.

    Only a local session without that setting gets a folder of its own; on a cluster a machine-local
    folder would die with its machine, so a missing setting is an error there."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="chronoscribe-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for a table of this application."""
    path = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def uri(path: str) -> str:
    """A path as a URI with a scheme, as file system libraries of the workers want it."""
    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path[len("file:"):]
    return path if "://" in path else "file://" + os.path.abspath(path)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint; partitions and their order stay as they are."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a written table: compressed, and later reads take only the columns they need."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of the jobs inside are removed as a job ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove_stored(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` has written for this application so far; their number.

    Call it when no frame that was made from them is needed any more, at the latest before the session is
    stopped: frames of an index or a search read them lazily."""
    paths = _STORED.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)
