"""Session helpers: a tuned local session, shared-folder materialisation and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dimension is broadcast only while its estimated in-memory size stays under this bound.
BROADCAST_BYTES = 64 << 20


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ohmgrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; only a local session may do without and gets an
    own one, as executors elsewhere would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ohmgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each context, so that its Python operators run wherever they land."""
    sc = spark.sparkContext
    if getattr(sc, "_ohmgrid_shipped", False):
        return
    here = Path(__file__).parent
    name = os.path.join(tempfile.mkdtemp(), "ohmgrid.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    sc.addPyFile(name)  # the driver serves it
    sc._ohmgrid_shipped = True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext.__dict__.setdefault("_ohmgrid_written", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete what materialize() has written in this context, once no result that reads it is needed any more."""
    sc = spark.sparkContext
    for path in sc.__dict__.pop("_ohmgrid_written", []):
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def join_dimension(fact: DataFrame, dim: DataFrame, key: str, row_bytes: int = 64, how: str = "inner") -> DataFrame:
    """Join fact to dim on key; dim is broadcast only if its counted rows fit BROADCAST_BYTES, else both sides shuffle
    and adaptive execution splits a skewed key."""
    if dim.count() * row_bytes <= BROADCAST_BYTES:
        dim = F.broadcast(dim)
    return fact.join(dim, key, how)
