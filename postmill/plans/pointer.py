"""Numbered pointer files: the highest one names what is current, and making it is the lock."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_NAME = "current-{:012d}.json"


class Conflict(RuntimeError):
    """Another writer published first."""


class Pointers:
    """JSON documents under rising numbers in one folder.

    A document is written whole under a name of its own and then renamed to its number, which fails
    if that number is taken. So a crash at any moment leaves the document before or the one after,
    and of two writers that read the same number one fails. Nothing is ever overwritten or deleted
    before a later number is there.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def fs(self):
        return self.path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        fs = self.fs()
        if not fs.exists(self.path()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self.path())]
        return sorted(int(n[8:-5]) for n in names if n.startswith("current-") and n.endswith(".json"))

    def latest(self) -> tuple[int, dict]:
        """The current number and its document; 0 and an empty one before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def read(self, number: int) -> dict:
        stream = self.fs().open(self.path(_NAME.format(number)))
        try:
            return json.loads(bytes(b & 0xFF for b in stream.readAllBytes()).decode())
        finally:
            stream.close()

    def forget(self, before: int) -> None:
        """Delete the pointer files with numbers below ``before``, never the current one."""
        for n in self.numbers()[:-1]:
            if n < before:
                self.fs().delete(self.path(_NAME.format(n)), False)

    def publish(self, document: dict, expected: int) -> int:
        """Make ``document`` current under ``expected + 1``; fails if a later number than ``expected`` is there."""
        number = expected + 1
        if self.numbers()[-1:] not in ([], [expected]):
            raise Conflict(f"another state was published since {expected} was read")
        fs, temp = self.fs(), self.path(f".{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = none
        try:
            context.rename(fs.makeQualified(temp), fs.makeQualified(self.path(_NAME.format(number))), options)
        except Exception as e:  # the file system's own error, wrapped by the gateway or by Spark
            fs.delete(temp, False)
            if number in self.numbers():
                raise Conflict(f"state {number} was published meanwhile") from e
            raise
        return number

    def remove(self, name: str) -> None:
        """Delete a folder below the root, if it is there."""
        self.fs().delete(self.path(name), True)


__all__ = ["Conflict", "Pointers"]
