"""Session helpers: shipping this package to executors that do not have it on their path."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Once per application: gives Python workers this package, unless PYTHONPATH already does."""
    top = Path(__file__).resolve().parent
    on_path = (os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p)
    app = spark.sparkContext.applicationId
    if app in _shipped or str(top.parent) in on_path:
        return
    _shipped.add(app)
    name = os.path.join(tempfile.mkdtemp(prefix="tideline-"), "tideline.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where that is absent and the master is local, so that all tasks
    share one machine, is it a temporary one of our own; a cluster without the setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tideline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tideline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote and that no later step reads, and has the driver's collector find what shuffles
    of finished steps left behind, which Spark then deletes too."""
    for table in tables:
        if path := _folders.pop(table, None):
            fs, p = file_system(table.sparkSession, path)
            fs.delete(p, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()
