"""Tables in the cluster's shared folder: intermediate tables, and generations of results with a pointer to the one in force.

A generation is staged whole in a folder of its own. A small file, replaced by one atomic rename, names the generation
that readers see, so a failure at any moment leaves the old rows in force. Superseded and abandoned generations are
removed once they are older than a grace time, as readers and writers of a moment ago may still need them.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder in the warehouse only where that is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (at or f"{spark.conf.get('spark.sql.warehouse.dir')}".rstrip("/") + "/checkpoints").rstrip("/")


def written(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """The table, computed once, written to the shared folder (with options of the writer) and read from there: its lineage ends here."""
    at = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _path(spark: SparkSession, at: str):
    """(file system, path) of Hadoop."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _read_text(spark: SparkSession, at: str) -> str | None:
    files, path = _path(spark, at)
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _replace_text(spark: SparkSession, at: str, text: str) -> None:
    """Write a small file beside `at` and put it in its place by one rename."""
    files, beside = _path(spark, f"{at}.{uuid.uuid4().hex}")
    stream = files.create(beside)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(beside, hadoop.Path(at), options)


@dataclass(frozen=True)
class Generations:
    """Tables by name and day below a root, each with a pointer to its generation in force."""

    spark: SparkSession
    root: str
    grace_seconds: float = 24 * 3600

    def _at(self, name: str, day: str) -> str:
        return f"{self.root.rstrip('/')}/{name}/as_of={day}"

    def stage(self, name: str, day: str, df: DataFrame) -> str:
        """Write a new generation that no reader sees yet; its name."""
        generation = f"gen-{uuid.uuid4().hex}"
        df.write.parquet(f"{self._at(name, day)}/{generation}")
        return generation

    def staged(self, name: str, day: str, generation: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._at(name, day)}/{generation}")

    def commit(self, name: str, day: str, generation: str) -> None:
        """Readers see the generation from here on."""
        _replace_text(self.spark, f"{self._at(name, day)}/{POINTER}", generation)

    def current(self, name: str, day: str) -> str | None:
        return _read_text(self.spark, f"{self._at(name, day)}/{POINTER}")

    def read(self, name: str, day: str) -> DataFrame | None:
        """The rows in force of a day, None if there are none. Only that day's files are listed; filters reach the scan."""
        generation = self.current(name, day)
        return None if generation is None else self.staged(name, day, generation)

    def days(self, name: str) -> list[str]:
        """The days that have rows in force, ascending."""
        files, path = _path(self.spark, f"{self.root.rstrip('/')}/{name}")
        found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        days = sorted(n.removeprefix("as_of=") for n in found if n.startswith("as_of="))
        return [d for d in days if self.current(name, d) is not None]

    def sweep(self, name: str, day: str) -> int:
        """Remove generations not in force and left-over pointer files older than the grace time; how many went."""
        keep, gone = {POINTER, self.current(name, day)}, 0
        files, path = _path(self.spark, self._at(name, day))
        for status in files.listStatus(path) if files.exists(path) else []:
            own = status.getPath().getName()
            old = time.time() - status.getModificationTime() / 1000 >= self.grace_seconds
            if own not in keep and old and own.startswith(("gen-", f"{POINTER}.")):
                gone += bool(files.delete(status.getPath(), True))
        return gone
