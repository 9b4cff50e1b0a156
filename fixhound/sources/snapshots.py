"""A sheet that is rewritten by every run and keeps its previous version.

Two slots take turns. A small log, appended to after a slot is complete, names the one to
read, so a run that dies while writing leaves the last good version in place, and the path
that is being read is never the one overwritten.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG_SCHEMA = "version BIGINT"


class SheetStore:
    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._path = path.rstrip("/")

    def _slot(self, version: int) -> str:
        return f"{self._path}/slot{version % 2}"

    def version(self) -> int:
        """The last complete version; 0 before the first."""
        try:
            log = self._spark.read.schema(_LOG_SCHEMA).parquet(f"{self._path}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        return log.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def read(self, back: int = 0) -> DataFrame:
        """The current sheet, or with `back=1` the one before it."""
        version = self.version() - back
        if version < 1 or back not in (0, 1):
            raise FileNotFoundError(f"no such version of the sheet in {self._path}")
        return self._spark.read.parquet(self._slot(version))

    def save(self, sheet: DataFrame) -> int:
        version = self.version() + 1
        sheet.write.mode("overwrite").parquet(self._slot(version))
        done = self._spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
        done.coalesce(1).write.mode("append").parquet(f"{self._path}/log")
        return version


def append_details(details: DataFrame, path: str, run: str) -> None:
    """Add the detail rows of a run. A run that is repeated replaces its own rows only."""
    details.write.mode("overwrite").parquet(f"{path}/run={run}")
