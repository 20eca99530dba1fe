"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Only where it is unset and Spark runs in one local
process is a temporary folder used instead; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings while a table is written: its shuffle files go once it is there, and the driver, which keeps the text of a
#: thousand plans, keeps the beginning of each.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("true", "false"), "spark.sql.maxPlanStringLength": ("4096", str(2**31 - 16))}

#: Bytes up to which a written table is broadcast in joins, which spares the shuffles of both sides.
SMALL = 2 << 20


#: Keys up to which a filter by keys alone is broadcast, so that only rows that are wanted go through a shuffle: 32 MB of longs.
KEYS = 4_000_000


def small(table: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``rows``, which are no more than the written ``table``'s, or the table itself, marked for broadcast if the table is small."""
    rows = table if rows is None else rows
    return F.broadcast(rows) if table._coffer_bytes <= SMALL else rows


def only(rows: DataFrame, key: str, wanted: DataFrame, of: str) -> DataFrame:
    """The ``rows`` whose ``key`` is in column ``of`` of the written table ``wanted``, or all of them if there are too many keys to broadcast."""
    if wanted.count() > KEYS:
        return rows
    return rows.join(F.broadcast(wanted.select(F.col(of).alias(key)).distinct()), key, "left_semi")


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="coffer-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Writes DataFrames as Parquet under one unique folder, which cuts lineage, and drops them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/coffer/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame, label: str = "t", options: dict | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{label}"
        conf, old = self.spark.conf, {k: self.spark.conf.get(k, default) for k, (_, default) in WRITING.items()}
        for k, (value, _) in WRITING.items():
            conf.set(k, value)
        try:
            df.write.options(**(options or {})).parquet(path)
        finally:
            for k, value in old.items():
                conf.set(k, value)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._coffer_path = path
        files, path = self._files(path)
        out._coffer_bytes = files.getContentSummary(path).getLength()
        return out

    def drop(self, df: DataFrame) -> None:
        files, path = self._files(df._coffer_path)
        files.delete(path, True)

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path
