"""Date folders of stored tables: listing, dropping, and markers of dates with work to do. File system calls of the driver
alone; their number grows with the folders, not with the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoscribe.functions.clock import seconds_before
from chronoscribe.session import stored


class Folder:
    """A folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self.system = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        place = self._path(f"{self.path}/{below}" if below else self.path)
        return sorted(s.getPath().getName() for s in self.system.listStatus(place)) if self.system.exists(place) else []

    def dates(self) -> list[str]:
        return [n[len("date="):] for n in self.names() if n.startswith("date=")]

    def drop(self, below: str) -> None:
        self.system.delete(self._path(f"{self.path}/{below}"), True)

    def touch(self, below: str) -> None:
        self.system.create(self._path(f"{self.path}/{below}"), True).close()


def drop_before(spark: SparkSession, path: str, ts: str, now, days: float) -> int:
    """Delete the rows of a table in date folders whose ``ts`` is older than ``days`` before ``now``; their number.

    Whole folders are dropped; only the day in which the limit falls is rewritten, by way of a copy, so that a crash leaves that day
    as it was or as it is to be. Files of later days are not touched. Rows are counted from the files' statistics, but for that day."""
    folder = Folder(spark, path)
    limit = seconds_before(now, days * 86_400)
    day = str(spark.range(1).select(F.to_date(limit)).first()[0])
    table = spark.read.parquet(path)
    old = [d for d in folder.dates() if d < day]
    deleted = table.filter(F.col("date").isin([F.to_date(F.lit(d)) for d in old])).count() if old else 0
    if day in folder.dates():
        whole = table.filter(F.col("date") == F.to_date(F.lit(day)))
        kept = stored(whole.filter(F.col(ts) >= limit))
        n, left = whole.count(), kept.count()
        deleted += n - left
        if not left:
            old.append(day)
        elif left < n:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    for d in old:
        folder.drop(f"date={d}")
    return deleted


class Pending:
    """Dates of a table that still have rows to work on: one empty marker file for each append and date.

    A writer sets its markers before it appends. Who has worked off a date removes the markers that were there before its rows
    were read, so rows that came meanwhile keep the date open. A date without a marker is settled and not read again."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def open(self, dates: list[str]) -> None:
        for d in dates:
            self.folder.touch(f"date={d}/{uuid.uuid4().hex}")

    def markers(self) -> dict[str, list[str]]:
        """Markers by date, at most one for each append that has not been worked off."""
        found = {d: self.folder.names(f"date={d}") for d in self.folder.dates()}
        return {d: names for d, names in found.items() if names}

    def settle(self, markers: dict[str, list[str]]) -> None:
        for d, names in markers.items():
            for n in names:
                self.folder.drop(f"date={d}/{n}")

    def low_water(self) -> str | None:
        """The earliest date that is open."""
        return min(self.markers(), default=None)


def dates_of(rows: DataFrame, ts: str) -> list[str]:
    """Days that ``rows`` has, at most one a day."""
    return sorted(str(r[0]) for r in rows.select(F.to_date(ts)).distinct().collect())
