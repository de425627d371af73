"""Waveforms in binary files, spread by file; readers of formats whose library is missing record the file as skipped."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, channel string, point_index long, time_val double, value double, skipped string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import h5py
    except ImportError:
        h5py = None
    try:
        from scipy.io import loadmat
    except ImportError:
        loadmat = None
    skip = lambda path, why: pd.DataFrame([(path, None, None, None, None, why)], columns=[c.split()[0] for c in SCHEMA.split(", ")])
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            name = path.lower()
            if name.endswith((".xls", ".xlsx")):
                try:
                    sheet = pd.read_excel(io.BytesIO(content)).apply(pd.to_numeric, errors="coerce")
                    for c in sheet.columns:
                        yield pd.DataFrame({"path": path, "channel": str(c), "point_index": range(len(sheet)), "time_val": None, "value": sheet[c], "skipped": None})
                except (ImportError, ValueError) as e:
                    yield skip(path, type(e).__name__)
            elif name.endswith((".h5", ".hdf5")) and h5py:
                with h5py.File(io.BytesIO(content)) as f:
                    for c in f:
                        a = dict(f[c].attrs)
                        raw = f[c][()].astype(float).ravel()
                        value = (raw - a.get("y_ref", 0.0)) * a.get("y_inc", 1.0) + a.get("y_org", 0.0)
                        at = a.get("x_org", 0.0) + a.get("x_inc", 1.0) * pd.Series(range(len(raw)), dtype=float)
                        yield pd.DataFrame({"path": path, "channel": c, "point_index": range(len(raw)), "time_val": at, "value": value, "skipped": None})
            elif name.endswith(".mat") and loadmat:
                for c, raw in loadmat(io.BytesIO(content)).items():
                    if not c.startswith("__"):
                        v = pd.Series(raw.astype(float).ravel())
                        yield pd.DataFrame({"path": path, "channel": c, "point_index": range(len(v)), "time_val": None, "value": v, "skipped": None})
            else:
                yield skip(path, "no reader")


def waveforms(spark: SparkSession, path: str, pattern: str = "*.{h5,hdf5,mat,xls,xlsx}") -> DataFrame:
    """(path, channel, point_index, time_val, value, skipped): every channel of every file, or why a file was skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(_read, SCHEMA)


def decimated(points: DataFrame, key: list[str], index: str, most: int) -> DataFrame:
    """Every stride-th point of a series, the stride so large that most points at most are left."""
    stride = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*key)) / most)
    return points.withColumn("_stride", stride).filter(F.pmod(index, "_stride") == 0).drop("_stride")


def channel_roles(peaks: DataFrame, key: list[str]) -> DataFrame:
    """(key, channel, role): of channels (key, channel, unit, peak), current ones by size are i_drain, i_gate; of voltage
    ones the first is v_drain and the last v_gate."""
    w = lambda *o: Window.partitionBy(*key, "unit").orderBy(*o)
    r = peaks.withColumn("_size", F.row_number().over(w(F.desc("peak"), "channel"))).withColumn("_n", F.row_number().over(w("channel"))).withColumn("_last", F.row_number().over(w(F.desc("channel"))))
    role = F.when(F.col("unit") == "A", F.when(F.col("_size") == 1, "i_drain").when(F.col("_size") == 2, "i_gate")).when(F.col("_n") == 1, "v_drain").when(F.col("_last") == 1, "v_gate")
    return r.select(*key, "channel", role.alias("role"))
