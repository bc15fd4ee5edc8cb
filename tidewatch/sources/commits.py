"""Which folders of a sink count: one marker a batch for all of its tables.

A batch writes its rows of every table to folders of its own, which nobody reads,
and then puts its marker in place by a rename that fails if the batch has one. So a
reader that goes by the markers sees a batch in all tables or in none, a second try
of a batch leaves no trace, and nothing that may be read is ever written over.
Small folders are merged into larger ones under a marker that stands for all
batches up to its own; readers of the old folders end undisturbed, until a vacuum.
"""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession


class Folder(NamedTuple):
    """A folder below each table: all batches from first to last."""

    first: int
    last: int
    name: str


class Ledger:
    """The markers of a sink at ``root``; their folder is listed at each question."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm, self._gateway = spark._jvm, spark._sc._gateway
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> dict[str, int]:
        """What lies in a folder, with the time of its last change in seconds."""
        path = self._path(folder)
        files = path.getFileSystem(self._conf)
        return {s.getPath().getName(): s.getModificationTime() // 1000 for s in files.listStatus(path)} if files.exists(path) else {}

    def _read(self, name: str) -> str:
        path = self._path(f"_commits/{name}")
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def folders(self) -> list[Folder]:
        """The folders that count: the last merged one and those of all batches after it."""
        names = [n.split(".") for n in self._names("_commits") if n.endswith((".batch", ".merged"))]
        merged = max((int(n) for n, kind in names if kind == "merged"), default=None)
        found = [] if merged is None else [Folder(0, merged, self._read(f"{merged:012d}.merged"))]
        later = sorted(int(n) for n, kind in names if kind == "batch" and (merged is None or int(n) > merged))
        return found + [Folder(n, n, self._read(f"{n:012d}.batch")) for n in later]

    def has(self, batch_id: int) -> bool:
        names = self._names("_commits")
        return f"{batch_id:012d}.batch" in names or any(n.endswith(".merged") and int(n.split(".")[0]) >= batch_id for n in names)

    def draft(self, batch_id: int) -> Folder:
        """A new folder for a try at a batch."""
        return Folder(batch_id, batch_id, f"folder=batch-{batch_id}-{uuid.uuid4().hex}")

    def publish(self, folder: Folder, kind: str = "batch") -> bool:
        """Make a folder count; false if its batch, or a merge up to it, is there already."""
        draft, final = self._path(f"_commits/.{uuid.uuid4().hex}"), self._path(f"_commits/{folder.last:012d}.{kind}")
        out = draft.getFileSystem(self._conf).create(draft, False)
        out.write(bytearray(folder.name.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        try:
            context.rename(draft, final, self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            draft.getFileSystem(self._conf).delete(draft, False)
            if "AlreadyExists" in str(error):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        folder = self._path(path)
        folder.getFileSystem(self._conf).delete(folder, True)

    def vacuum(self, tables: list[str], retention_seconds: float) -> list[str]:
        """Remove folders and markers that no longer count and were not changed for so long; names of what went.

        The retention must exceed the time of a read and of a try at a batch.
        """
        before = time.time() - retention_seconds
        counted = self.folders()
        merged = [f.last for f in counted if f.name.startswith("folder=merged-")]
        gone = []
        for table in tables:
            for name, changed in self._names(table).items():
                if name not in {f.name for f in counted} and changed <= before:
                    gone.append(f"{table}/{name}")
        for name, changed in self._names("_commits").items():
            number, _, kind = name.partition(".")
            superseded = merged and number.isdigit() and (int(number) < merged[0] or (kind == "batch" and int(number) == merged[0]))
            if (superseded or name.startswith(".")) and not name.endswith(".crc") and changed <= before:
                gone.append(f"_commits/{name}")
        for path in gone:
            self.remove(path)
        return sorted(gone)
