"""Cutting lineage through tables in the folder that all executors share.

Iterative operators write each generation as Parquet below the session's ``spark.checkpoint.dir``: a lost executor then
costs a task retry and not the loop's history, and the next generation's plan starts at a scan with known statistics.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests, local runs) a temporary folder of this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="graphloom-"))
        atexit.register(_sweep)
    return _OWN_DIR[0]


def _sweep() -> None:
    import shutil

    for path in _OWN_DIR:
        shutil.rmtree(path, ignore_errors=True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of any Hadoop file system."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_ROOTS: list[tuple[SparkSession, str]] = []


def _drop_roots() -> None:
    for spark, root in _ROOTS:
        try:
            delete_path(spark, root)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass


class SharedTables:
    """Generations of intermediate tables in the shared folder.

    ``replace`` drops a generation once its successor is written. What results still read stays until the driver's
    process ends, or until ``close`` is called.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
        self._n, self._replaced = 0, None
        if not _ROOTS:
            atexit.register(_drop_roots)  # runs before the gateway's own handler, which was registered earlier
        _ROOTS.append((spark, self.root))

    def put(self, df: DataFrame) -> DataFrame:
        """Write the rows and return a scan of them."""
        path = f"{self.root}/t{self._n}"
        self._n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``put``, and the number of rows."""
        out = self.put(df)
        return out, out.count()

    def replace(self, df: DataFrame) -> DataFrame:
        """``put``, and drop the table that the previous call of ``replace`` wrote; nothing may read that one any more."""
        old, self._replaced = self._replaced, self._n
        out = self.put(df)
        if old is not None:
            delete_path(self.spark, f"{self.root}/t{old}")
        return out

    def close(self) -> None:
        """Drop all tables."""
        delete_path(self.spark, self.root)
