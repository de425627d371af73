"""File listings: search, companions, channel groups, hashes, and what has gone or come since the last listing.

Defined results: null paths match nothing; paths are compared in lower case; ties go to the first path by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.operators.statistics import mode


def crawl(spark: SparkSession, path: str, extensions: tuple[str, ...], exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, modified) below a folder, of some extensions and without excluded parts; contents are not read."""
    ext = "*.{" + ",".join(extensions) + "}"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", ext).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    for x in exclude:
        f = f.filter(~F.lower("path").contains(x.lower()))
    return f


def search(listing: DataFrame, path: str, terms: str) -> DataFrame:
    """Rows whose path has every blank-separated term."""
    out = listing
    for t in terms.lower().split():
        out = out.filter(F.lower(path).contains(t))
    return out


def stem(path: str):
    return F.regexp_replace(F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1), r"\.[^.]*$", "")


def companions(files: DataFrame, listing: DataFrame, path: str, extension: str, levels: int = 5, folder: str | None = "lib") -> DataFrame:
    """(path, companion): `<folder>/<stem>.<extension>` below the file's own folder or, up to levels folders in all, one
    above; folder None is the folder itself. The whole stem is looked for everywhere first, then the stem without
    `_append` and its number, then without a number in front."""
    parts = F.split(F.translate(F.lower(path), "\\", "/"), "/")
    dirs = F.array_compact(F.array(*(F.when(F.size(parts) > i + 1, F.struct(F.lit(i).alias("up"), F.array_join(F.slice(parts, 1, F.size(parts) - 1 - i), "/").alias("dir"))) for i in range(levels))))
    s = F.lower(stem(path))
    stems = F.array(*(F.struct(F.lit(i).alias("variant"), x.alias("s")) for i, x in enumerate((s, F.regexp_replace(s, r"_append[0-9]*$", ""), F.regexp_replace(s, r"^[0-9]+_", "")))))
    want = files.select(path, F.explode(dirs).alias("d"), stems.alias("stems")).select(path, "d", F.explode("stems").alias("v"))
    want = want.select(path, "d.up", "v.variant", F.concat("d.dir", F.lit(f"/{folder}/" if folder else "/"), "v.s", F.lit(f".{extension}")).alias("_c"))
    there = listing.select(F.translate(F.lower("path"), "\\", "/").alias("_c"), F.col("path").alias("companion"))
    return want.join(there, "_c").groupBy(path).agg(F.min(F.struct("variant", "up", "companion")).alias("m")).select(path, "m.companion")


def channel_groups(files: DataFrame, path: str) -> DataFrame:
    """(base, channels, paths): files that differ only in `_chN`."""
    base = F.regexp_replace(path, r"(?i)_ch[0-9]+(?=\.[^.]*$)", "")
    return files.filter(F.col(path).isNotNull()).groupBy(base.alias("base")).agg(F.count("*").alias("channels"), F.array_sort(F.collect_set(path)).alias("paths"))


def new_files(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row, the first by id, for each hash that is not known yet."""
    first = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("id"))
    return first.join(known.select(key).distinct(), key, "left_anti")


def group_hash(files: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group, group_hash): one hash of the sorted hashes of a group's files."""
    return files.filter(F.col(key).isNotNull()).groupBy(*group).agg(F.md5(F.array_join(F.array_sort(F.collect_list(key)), "")).alias("group_hash"))


def gone(existing: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Existing rows whose path is no longer listed; rows without a path stay."""
    return existing.filter(F.col(path).isNotNull()).join(listing.select(path).distinct(), path, "left_anti")


def remapped(existing: DataFrame, mapping: DataFrame, path: str, key: str, value: str) -> DataFrame:
    """existing with value from mapping by path, else by hash; a row that neither gives a value keeps its own."""
    by = [mode(mapping, [c], value).select(c, F.col(value).alias(f"_{c}")) for c in (path, key)]
    out = existing.join(by[0], path, "left").join(by[1], key, "left")
    got = F.coalesce(F.col(f"_{path}"), F.col(f"_{key}"))
    return out.withColumn("changed", got.isNotNull() & ~got.eqNullSafe(F.col(value))).withColumn(value, F.coalesce(got, value)).drop(f"_{path}", f"_{key}")
