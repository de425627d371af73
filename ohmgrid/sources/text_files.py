"""Instrument text files as DataFrames: (path, content) in, points out, parsed by JVM expressions.

read_texts() gives one row per file. Each parser splits a file's lines inside its row and explodes the data rows, so files
are spread over tasks and no line leaves the JVM.

Defined results: blank or NaN cells are null; a row whose cells don't match the header in number, or whose cells are all
null, is dropped; files without a header give no rows; empty files and empty folders give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header names (folded) of the seven channels.
CHANNEL = {
    "v_gate": "v_gate", "vg": "v_gate", "vgs": "v_gate", "i_gate": "i_gate", "ig": "i_gate", "igs": "i_gate", "v_drain": "v_drain", "vd": "v_drain", "vds": "v_drain",
    "i_drain": "i_drain", "id": "i_drain", "ids": "i_drain", "rds": "rds", "bv": "bv", "time": "time_val", "t": "time_val",
}


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _lines() -> Column:
    return F.filter(F.split("content", r"\r\n|\n|\r"), lambda x: F.trim(x) != "")


def _number(c: Column) -> Column:
    v = F.trim(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def _separator(header: Column) -> Column:
    """What splits a header, as a pattern: `;`, `|` or a tab where there is one, else the comma."""
    return F.when(F.contains(header, F.lit(";")), ";").when(F.contains(header, F.lit("|")), "[|]").when(F.contains(header, F.lit("\t")), "\t").otherwise(",")


def _cells(files: DataFrame, header: Column, body: Column, separator: str | Column) -> DataFrame:
    """(path, row_no, base, step, value) of every cell of the rows that fit the header."""
    base = lambda h: F.regexp_replace(F.lower(F.trim(F.regexp_replace(h, r"\([^)]*\)|\[[^\]]*\]", ""))), r"\s+", "_")
    step = lambda h: F.coalesce(F.regexp_extract(h, r"\(([0-9]+)\)", 1).try_cast("int"), F.lit(1))
    heads = F.transform(F.split(header, separator), lambda h: F.struct(base(h).alias("base"), step(h).alias("step")))
    rows = files.select("path", heads.alias("heads"), body.alias("body"), (F.lit(separator) if isinstance(separator, str) else separator).alias("by")).select("path", "heads", "by", F.posexplode("body").alias("row_no", "line")).withColumn("parts", F.split("line", F.col("by"))).filter("size(parts) = size(heads)")
    flat = rows.select("path", "row_no", F.explode(F.arrays_zip("heads", "parts")).alias("z"))
    return flat.select("path", "row_no", F.col("z.heads.base").alias("base"), F.col("z.heads.step").alias("step"), _number(F.col("z.parts")).alias("value"))


def _wide(cells: DataFrame) -> DataFrame:
    """Cells as (path, row_no, step, the seven channels); rows without any value are dropped."""
    name = F.lit(None).cast("string")
    for h, c in CHANNEL.items():
        name = F.when(F.col("base") == h, c).otherwise(name)
    channels = sorted(set(CHANNEL.values()))
    out = cells.withColumn("channel", name).filter("channel IS NOT NULL").groupBy("path", "row_no", "step").agg(*(F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in channels))
    return out.filter(F.coalesce(*channels).isNotNull())


def curve_csv(files: DataFrame, separator: str | None = ",") -> DataFrame:
    """Curve-tracer files: a header (`V_Drain(1),...` is unpivoted by step), data; a row with a cell that names a GROUP is
    skipped behind the header, and a line that begins with GROUP before it. separator: None finds each file's own."""
    group = lambda i: F.upper(F.get("l", i))
    skip = F.when(group(F.lit(0)).startswith("GROUP"), 1).otherwise(0)
    f = files.withColumn("l", _lines()).withColumn("s", skip).filter("size(l) > s")
    header = F.get("l", F.col("s"))
    begin = F.col("s") + 1 + F.when(F.contains(group(F.col("s") + 1), F.lit("GROUP")), 1).otherwise(0)
    return _wide(_cells(f, header, F.slice("l", begin + 1, F.greatest(F.size("l") - begin, F.lit(0))), _separator(header) if separator is None else separator))


def two_header_csv(files: DataFrame, separator: str = ",") -> DataFrame:
    """Files with channel labels in the first line and names in the second."""
    f = files.withColumn("l", _lines()).filter("size(l) > 1")
    return _wide(_cells(f, F.get("l", F.lit(1)), F.slice("l", 3, F.greatest(F.size("l") - 2, F.lit(0))), separator))


def scope_csv(files: DataFrame) -> DataFrame:
    """Oscilloscope files: (path, row_no, time_val, v_drain, i_drain, v_gate) of every line of four numbers."""
    rows = files.select("path", F.posexplode(_lines()).alias("row_no", "line")).withColumn("p", F.split("line", "[,;\t]"))
    cols = [_number(F.get("p", F.lit(i))).alias(c) for i, c in enumerate(("time_val", "v_drain", "i_drain", "v_gate"))]
    return rows.filter("size(p) >= 4").select("path", "row_no", *cols).filter("time_val IS NOT NULL")


#: Columns of a monitor file, and those of the rows that leave the gate out.
MONITOR = ("time_val", "v_drain", "i_drain", "v_gate", "i_gate", "board_ms", "fluence")
SHORT_MONITOR = ("time_val", "v_drain", "i_drain", "board_ms", "fluence")
MONITOR_NAMES = CHANNEL | {"fluence": "fluence", "fluence_cm2": "fluence", "fluence_per_cm2": "fluence"}


def monitor_txt(files: DataFrame) -> DataFrame:
    """Monitor files: `key = value` lines, perhaps a header of seven names, then tab-separated rows of seven columns, or of
    five that leave the gate out. Seven columns go by the header's names, else by MONITOR; five by SHORT_MONITOR."""
    names = ("time_val", "v_gate", "i_gate", "v_drain", "i_drain", "fluence")
    fold = lambda h: F.regexp_replace(F.lower(F.trim(F.regexp_replace(h, r"\([^)]*\)|\[[^\]]*\]", ""))), r"[\s_]+", "_")
    known = F.create_map(*(F.lit(x) for kv in MONITOR_NAMES.items() for x in kv))
    is_head = lambda x: (F.size(F.split(x, "\t")) >= 7) & (fold(F.get(F.split(x, "\t"), F.lit(0))).isin("time", "time_val", "t"))
    f = files.select("path", _lines().alias("l")).withColumn("head", F.get(F.filter("l", is_head), F.lit(0)))
    heads = F.transform(F.split("head", "\t"), lambda h: known[fold(h)])
    f = f.withColumn("heads", F.coalesce(heads, F.array(*map(F.lit, MONITOR))))
    rows = f.select("path", "heads", F.posexplode("l").alias("row_no", "line")).withColumn("p", F.split("line", "\t"))
    cell = lambda n: F.get("p", (F.array_position(F.when(F.size("p") == 5, F.array(*map(F.lit, SHORT_MONITOR))).otherwise(F.col("heads")), n) - 1).cast("int"))
    there = lambda n: F.array_contains(F.when(F.size("p") == 5, F.array(*map(F.lit, SHORT_MONITOR))).otherwise(F.col("heads")), n)
    pick = [_number(F.when(there(n), cell(n))).alias(n) for n in names]
    return rows.filter("size(p) = 5 OR size(p) >= 7").select("path", "row_no", *pick).filter("time_val IS NOT NULL")


def settings(files: DataFrame) -> DataFrame:
    """(path, key, value) of the `key = value` lines of a file."""
    rows = files.select("path", F.explode(_lines()).alias("line"))
    return rows.select("path", F.regexp_extract("line", r"^\s*([A-Za-z_][A-Za-z0-9_ .]*?)\s*[=:]\s*(.*?)\s*$", 1).alias("key"), F.regexp_extract("line", r"^\s*([A-Za-z_][A-Za-z0-9_ .]*?)\s*[=:]\s*(.*?)\s*$", 2).alias("value")).filter("key <> ''")


#: Parameters of a test script: name and the expression that finds its value.
SCRIPT = {
    "compliance": r"(?i)\.limiti\s*=\s*([-+0-9.eE]+)", "plc": r"(?i)\.nplc\s*=\s*([-+0-9.eE]+)", "bias": r"(?i)\.levelv\s*=\s*([-+0-9.eE]+)", "delay": r"(?i)\bdelay\(\s*([-+0-9.eE]+)\s*\)",
    "sweep_start": r"(?i)sweepv?lin\w*\([^,]*,\s*([-+0-9.eE]+)", "sweep_stop": r"(?i)sweepv?lin\w*\([^,]*,[^,]*,\s*([-+0-9.eE]+)", "sweep_points": r"(?i)sweepv?lin\w*\([^,]*,[^,]*,[^,]*,[^,]*,\s*([0-9]+)",
}


def script_parameters(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, a double per parameter of SCRIPT): the first value that a test script gives each."""
    return files.select(key, *(F.regexp_extract(content, p, 1).try_cast("double").alias(n) for n, p in SCRIPT.items()))
