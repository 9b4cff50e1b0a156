"""A sheet of many files whose update rewrites only the files that hold a changed row, for several writers.

Data files never change. A version is one small file of the log, with a line for each data file that it
adds (its least and greatest row number and its rows) or removes. The log file is complete under
another name before it is renamed to its version's. The rename fails if the version exists, so of two
writers one is second; it looks at what the first removed, and starts again only if both rewrote
the same file. HDFS renames in one step; an object store without such a rename needs one writer.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixhound.operators.sheet import update_found
from fixhound.operators.spread import durable

_LOG_SCHEMA = "version BIGINT, action STRING, path STRING, low BIGINT, high BIGINT, n_rows BIGINT"
TRIES = 20


@dataclass(frozen=True)
class Change:
    """Files written against a version, not yet part of the sheet."""

    base: int
    added: list[dict]
    removed: list[str]


class SheetTable:
    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._path = path.rstrip("/")

    def _log(self) -> DataFrame:
        reader = self._spark.read.schema(_LOG_SCHEMA).option("pathGlobFilter", "*.json")
        try:
            return reader.json(f"{self._path}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], _LOG_SCHEMA)

    def version(self) -> int:
        """The last version; 0 before the first."""
        return self._log().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def files(self, version: int) -> DataFrame:
        """The data files of a version: `path, low, high, n_rows`."""
        seen = self._log().where(F.col("version") <= version).groupBy("path")
        states = seen.agg(F.count_if(F.col("action") == "remove").alias("gone"), *[F.max(c).alias(c) for c in ("low", "high", "n_rows")])
        return states.where("gone = 0").drop("gone")

    def read(self, version: int | None = None) -> DataFrame:
        """The sheet, or an earlier version of it."""
        wanted = self.version() if version is None else version
        paths = [row.path for row in self.files(wanted).select("path").collect()]
        if not paths:
            raise FileNotFoundError(f"no such version of the sheet in {self._path}")
        return self._read(paths)

    def _read(self, paths: list[str]) -> DataFrame:
        return self._spark.read.parquet(*[f"{self._path}/{path}" for path in paths])

    def create(self, sheet: DataFrame, n_files: int) -> int:
        """The first version, in about `n_files` ranges of row numbers."""
        change = Change(0, self._write(sheet, n_files), [])
        if self.version() or not self._publish(1, change):
            raise FileExistsError(f"there is a sheet in {self._path}")
        return 1

    def update(self, cells: DataFrame) -> int:
        """Write cells `(row_index, found)` into the result column; the version that has them.

        A null cell changes nothing, nor does one for a row that the sheet lacks. Of several cells of a row,
        the greatest counts. If another writer changed the same file meanwhile, the update is made again on
        top of that, so no cell is lost; on the same row the later update counts.
        """
        given = cells.where("found IS NOT NULL").groupBy("row_index").agg(F.max("found").alias("found"))
        fresh = durable(given)
        for _ in range(TRIES):
            change = self.prepare(fresh)
            if not change.removed:
                return change.base
            version = self.commit(change)
            if version is not None:
                return version
        raise RuntimeError(f"{TRIES} updates in a row met another writer in {self._path}")

    def prepare(self, cells: DataFrame) -> Change:
        """Rewrite the files that hold a row of `cells`.

        The manifest leaves out files beyond the cells' row numbers; of the others only that column is read.
        """
        base = self.version()
        low, high = cells.agg(F.min("row_index"), F.max("row_index")).first()
        if low is None:
            return Change(base, [], [])
        near = self.files(base).where((F.col("high") >= low) & (F.col("low") <= high))
        paths = [row.path for row in near.select("path").collect()]
        if not paths:
            return Change(base, [], [])
        numbers = self._read(paths).select("row_index", _file_name())
        hit = numbers.join(cells.select("row_index"), "row_index", "left_semi").select("path").distinct()
        touched = sorted(row.path for row in hit.collect())
        if not touched:
            return Change(base, [], [])
        return Change(base, self._write(update_found(self._read(touched), cells), len(touched)), touched)

    def commit(self, change: Change) -> int | None:
        """Make a change part of the sheet; None if a file that it rewrote was rewritten since."""
        while True:
            later = self._log().where(F.col("version") > change.base)
            latest = later.agg(F.coalesce(F.max("version"), F.lit(change.base))).first()[0]
            both = later.where((F.col("action") == "remove") & F.col("path").isin(change.removed))
            if not both.isEmpty():
                return None
            if self._publish(latest + 1, change):
                return latest + 1

    def _write(self, sheet: DataFrame, n_files: int) -> list[dict]:
        name = f"data/{uuid.uuid4().hex}"
        sheet.repartitionByRange(n_files, "row_index").write.parquet(f"{self._path}/{name}")
        written = self._spark.read.parquet(f"{self._path}/{name}").select("row_index", _file_name())
        sizes = written.groupBy("path").agg(
            F.min("row_index").alias("low"), F.max("row_index").alias("high"), F.count("*").alias("n_rows")
        )
        return [row.asDict() for row in sizes.collect()]

    def _publish(self, version: int, change: Change) -> bool:
        """Name the log file of a version; False if the version exists."""
        lines = [{"version": version, "action": "add", **file} for file in change.added]
        lines += [{"version": version, "action": "remove", "path": path} for path in change.removed]
        fs = self._spark._jvm.org.apache.hadoop.fs
        conf = self._spark._jsc.hadoopConfiguration()
        target = fs.Path(f"{self._path}/log/{version:020d}.json")
        system = target.getFileSystem(conf)
        target = system.makeQualified(target)
        waiting = system.makeQualified(fs.Path(f"{self._path}/log/_{uuid.uuid4().hex}"))
        out = system.create(waiting, False)
        out.write(bytearray("\n".join(json.dumps(line) for line in lines).encode()))
        out.close()
        keep = self._spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(target.toUri(), conf).rename(waiting, target, keep)
        except Py4JJavaError as error:
            if not error.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            system.delete(waiting, False)
            return False
        return True


def _file_name():
    """The file of a row, below the sheet's folder."""
    return F.regexp_extract("_metadata.file_path", r"(data/[^/]+/[^/]+)$", 1).alias("path")
