"""What runs on a cluster need: the shared folder, lineage cuts, and this package on the executors."""

from __future__ import annotations

import atexit
import ctypes
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir. Where that is unset, a local session gets a temporary one, which goes at exit; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.siftwell.ownCheckpointDir", None)
        if not folder:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            own = tempfile.mkdtemp(prefix="siftwell-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            folder = "file://" + own
            spark.conf.set("spark.siftwell.ownCheckpointDir", folder)
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def share(spark: SparkSession, data: bytes, name: str) -> str:
    """Write bytes to the shared folder; returns the path."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{name}")
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    for at in range(0, len(data), 1 << 20):
        stream.write(bytearray(data[at : at + (1 << 20)]))
    stream.close()
    return path.toString()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_siftwell_shipped", False):
        return
    root, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(share(spark, out.getvalue(), f"siftwell-{uuid.uuid4().hex}.zip"))
    sc._siftwell_shipped = True


def release() -> None:
    """Give freed memory back to the system: Python workers live on from task to task, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
