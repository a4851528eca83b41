"""Session helpers: reading tables, shipping the package, shared folder, checked broadcasts."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local, as in tests, a folder of our own is made; a cluster must set it.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="postmill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/postmill-{uuid.uuid4().hex}/postmill.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(buf.getvalue()))
    out.close()
    sc.addPyFile(path.toUri().toString())
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Bytes, at most, of a frame that is broadcast, as its rows are in JSON.
BROADCAST_BYTES = 16_000_000


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast of ``df`` if it is found to have at most ``max_rows`` rows and ``BROADCAST_BYTES`` bytes.

    ``df`` should already be materialised (``cut``): up to the bound its rows are counted and measured before the
    hint is given. Beyond the bounds the plain frame comes back, so that the join is a shuffle join.
    """
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= BROADCAST_BYTES else df
