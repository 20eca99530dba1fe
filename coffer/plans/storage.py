"""The ledger's files, through Hadoop's file systems: a local folder, HDFS or an object store with atomic creation.

A version's tables are Parquet folders; ``CURRENT`` names the folders that make up each table now and is replaced in one step.
``LOCK`` is made by exclusive creation and names its owner and its time. A lock that its owner left behind is
taken over after ``STALE_SECONDS``; a publisher that lost its lock meanwhile does not publish.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from coffer.errors import CofferError

# Fixed value: how long a writer waits for the lock.
WAIT_SECONDS = 0.25
STALE_SECONDS = 3600.0


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(""))
        self._conf = spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        except (Py4JJavaError, UnicodeDecodeError) as e:
            raise CofferError("ledger_corrupt", f"{name} can't be read.") from e
        finally:
            stream.close()

    def create(self, name: str, text: str, overwrite: bool = False) -> bool:
        """Writes a file; without ``overwrite`` only if there is none, else False."""
        try:
            stream = self.fs.create(self._path(name), overwrite)
        except Py4JJavaError as e:
            if not overwrite and self.fs.exists(self._path(name)):
                return False
            raise CofferError("ledger_init_permission_denied", str(e.java_exception)) from e
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Puts a file in the place of another in one step."""
        temporary = f"{name}.{uuid.uuid4().hex}"
        self.create(temporary, text)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf).rename(self._path(temporary), self._path(name), how)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def _holder(self) -> dict | None:
        text = self.read("LOCK")
        try:
            return None if text is None else json.loads(text)
        except ValueError:  # its writer is between creating and filling it, or died there
            status = self.fs.getFileStatus(self._path("LOCK"))
            return {"owner": None, "time": status.getModificationTime() / 1000}

    @contextmanager
    def lock(self) -> Iterator[str]:
        owner, until = uuid.uuid4().hex, time.time() + WAIT_SECONDS
        while not self.create("LOCK", json.dumps({"owner": owner, "time": time.time()})):
            holder = self._holder()
            if holder and time.time() - holder["time"] > STALE_SECONDS:
                self.delete("LOCK")
            elif time.time() > until:
                raise CofferError("ledger_locked", "Another writer holds the ledger.")
            time.sleep(0.02)
        try:
            yield owner
        finally:
            if (self._holder() or {}).get("owner") == owner:
                self.delete("LOCK")

    def check(self, owner: str) -> None:
        if (self._holder() or {}).get("owner") != owner:
            raise CofferError("ledger_locked", "The lock was taken over by another writer; nothing was published.")
