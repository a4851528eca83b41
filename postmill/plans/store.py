"""State tables as immutable numbered snapshots behind one pointer.

Plain Parquet has no merge: the next state is computed from the current one, written beside it under
the next number, and made current by a small pointer file that is written last. Several tables that
change together, and the offsets of their sources, share a number, so a crash before the pointer
leaves the old state of all of them valid. No path is ever read and overwritten. A table may be kept
in parts by a hash of its key; a part that nothing touched is carried on by name, not written again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.plans.pointer import Pointers

# Snapshots before the current one whose files stay, for readers that began on them.
KEPT = 2


class SnapshotStore:
    """Tables under one number; ``parts`` parts for each table that is published with a key."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 16) -> None:
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        self.pointers = Pointers(spark, root)

    def _now(self) -> tuple[int, dict]:
        number, doc = self.pointers.latest()
        return number, doc or {"tables": {}, "offsets": {}}

    @property
    def number(self) -> int:
        return self._now()[0]

    @property
    def offsets(self) -> dict:
        return self._now()[1]["offsets"]

    def part_of(self, key: list[str]):
        """The part in which the row of a key is kept."""
        return F.pmod(F.xxhash64(*key), F.lit(self.parts)).cast("int")

    def read(self, table: str, schema: str, only: list[int] | None = None) -> DataFrame:
        """The current state of a table, or of some of its parts; empty before its first write."""
        at = self._now()[1]["tables"].get(table, {})
        paths = sorted({f"{self.root}/{folder}/part={p}" if p != "all" else f"{self.root}/{folder}" for p, folder in at.items() if only is None or p == "all" or int(p) in only})
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, tables: dict[str, DataFrame], offsets: dict | None = None, expected: int | None = None, keys: dict[str, list[str]] | None = None, only: dict[str, list[int]] | None = None) -> int:
        """Write tables and offsets as the next state and make it current; returns its number.

        With ``expected`` it fails if another state was published since that one was read. A table in
        ``keys`` is written in parts; with ``only`` the frame holds the rows of those parts, and the
        others are carried on as they are.
        """
        number, now = self._now()
        expected = number if expected is None else expected
        if number != expected:
            raise RuntimeError(f"state {number} was published since {expected} was read")
        at = {t: dict(p) for t, p in now["tables"].items()}
        for name, df in tables.items():
            folder = f"{name}/snapshot={expected + 1}-{uuid.uuid4().hex[:8]}"
            key = (keys or {}).get(name)
            if key is None:
                df.write.parquet(f"{self.root}/{folder}")
                at[name] = {"all": folder}
                continue
            df.withColumn("part", self.part_of(key)).repartition(self.parts, "part").write.partitionBy("part").parquet(f"{self.root}/{folder}")
            fs, path = self.pointers.fs(), self.pointers.path
            written = range(self.parts) if only is None or name not in only else only[name]
            kept = {} if only is None or name not in only else {p: f for p, f in at.get(name, {}).items() if int(p) not in only[name]}
            at[name] = kept | {str(p): folder for p in written if fs.exists(path(f"{folder}/part={p}"))}
        document = {"tables": at, "offsets": now["offsets"] | (offsets or {})}
        number = self.pointers.publish(document, expected)
        self._clean(number)
        return number

    def _clean(self, number: int) -> None:
        """Remove what neither the current snapshot nor one of the ``KEPT`` before it names."""
        fs, path = self.pointers.fs(), self.pointers.path
        docs = [self.pointers.read(n) for n in self.pointers.numbers() if n >= number - KEPT]
        held = {f for doc in docs for parts in doc["tables"].values() for f in parts.values()}
        for table in docs[-1]["tables"]:
            for s in fs.listStatus(path(table)):
                name = s.getPath().getName()
                made = int(name.split("=")[1].split("-")[0]) if name.startswith("snapshot=") else number
                if f"{table}/{name}" not in held and made < number - KEPT:
                    fs.delete(s.getPath(), True)
        self.pointers.forget(number - KEPT)
