"""Leases on tenants in a shared folder, so that of several pollers one works on a tenant at a time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession


class Leases:
    """A file per tenant that only one owner can create. A lease ends when it is released or its time is over; a cursor is the stream checkpoint of the tenant (``cursor``).

    ``clock`` gives seconds. Taking over a lease that is over is done by renaming it away, which only one taker can do.
    """

    def __init__(self, spark: SparkSession, path: str, seconds: float = 60.0, clock: Callable[[], float] = time.time):
        if seconds <= 0:
            raise ValueError("a lease must last")
        self.path, self.seconds, self.clock = path, seconds, clock
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _file(self, tenant: str, ending: str = "lease"):
        if not tenant or "/" in tenant:
            raise ValueError("a tenant needs a name without slashes")
        file = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tenant}.{ending}")
        return file, file.getFileSystem(self._conf)

    def holder(self, tenant: str) -> tuple[str, float] | None:
        """(owner, when the lease ends), or None if nobody holds it, or its time is over."""
        file, files = self._file(tenant)
        if not files.exists(file):
            return None
        stream = files.open(file)
        try:
            owner, until = stream.readUTF(), stream.readDouble()
        finally:
            stream.close()
        return (owner, until) if until > self.clock() else None

    def acquire(self, tenant: str, owner: str) -> bool:
        """Whether the owner holds the lease now; a holder that asks again renews it."""
        held = self.holder(tenant)
        if held and held[0] != owner:
            return False
        file, files = self._file(tenant)
        if files.exists(file):
            gone, _ = self._file(tenant, f"over-{owner}")
            if not files.rename(file, gone):
                return False
            files.delete(gone, False)
        try:
            stream = files.create(file, False)  # fails if another was faster
        except Exception as e:  # noqa: BLE001
            if "exist" in str(e).lower():
                return False
            raise
        try:
            stream.writeUTF(owner)
            stream.writeDouble(float(self.clock() + self.seconds))
        finally:
            stream.close()
        return True

    def release(self, tenant: str, owner: str) -> bool:
        """Whether the owner held the lease and gave it up."""
        held = self.holder(tenant)
        if not held or held[0] != owner:
            return False
        file, files = self._file(tenant)
        return files.delete(file, False)

    def cursor(self, tenant: str) -> str:
        """The folder of the tenant's stream checkpoint: who holds the lease goes on where the last holder stopped."""
        self._file(tenant)
        return f"{self.path}/{tenant}.cursor"
