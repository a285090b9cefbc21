"""A lease on a folder for file systems without an exclusive create, where listings show finished writes.

Who wants it writes a claim of its own, waits until claims that were under way have become visible, and holds the lease while
no older claim that hasn't run out is listed. A holder that died is passed over once its claim has run out.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


class LeaseError(RuntimeError):
    """The lease wasn't to be had in time, or ran out while it was held."""


class Lease:
    def __init__(self, spark: SparkSession, folder: str, seconds: float = 30.0, settle: float = 0.5, wait: float = 120.0):
        """``seconds``: how long a claim holds. ``settle``: the longest that a write takes to be listed. ``wait``: for others."""
        self.spark, self.folder, self.seconds, self.settle, self.wait = spark, folder.rstrip("/"), seconds, settle, wait

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def _claim(self) -> str:
        """A claim is an empty file; its time is the file system's, so clocks of writers don't matter."""
        name = uuid.uuid4().hex
        fs, target = self._fs(f"{self.folder}/{name}")
        fs.create(target, False).close()
        return name

    def _claims(self) -> list[tuple[float, str]]:
        """Claims that haven't run out, oldest first, by the newest time that the file system knows; others are deleted."""
        fs, folder = self._fs(self.folder)
        found = [(f.getModificationTime() / 1e3, f.getPath().getName(), f.getPath()) for f in fs.listStatus(folder)]
        newest = max((at for at, _, _ in found), default=0.0)
        for at, _, path in found:
            if at < newest - self.seconds:
                fs.delete(path, False)
        return sorted((at, name) for at, name, _ in found if at >= newest - self.seconds)

    @contextlib.contextmanager
    def held(self) -> Iterator[None]:
        """Holds the lease; raises if it ran out before the block was left, as another may have had it then."""
        began = time.monotonic()
        name = self._claim()
        try:
            time.sleep(self.settle)
            while (first := self._claims()[0][1]) != name:
                if time.monotonic() - began > self.wait:
                    raise LeaseError(f"{self.folder} is held by {first}")
                # a claim of its own that ages behind the holder's would run out with it
                self._delete(name)
                time.sleep(self.settle)
                name = self._claim()
                time.sleep(self.settle)
            held = time.monotonic()
            yield
            if time.monotonic() - held > self.seconds - 2 * self.settle:
                raise LeaseError(f"the lease of {self.folder} ran out")
        finally:
            self._delete(name)

    def _delete(self, name: str) -> None:
        fs, target = self._fs(f"{self.folder}/{name}")
        fs.delete(target, False)
