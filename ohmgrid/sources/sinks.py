"""Writing and changing tables without a transaction manager: every change is a new DataFrame, written as a whole.

Defined results: keys of which nulls occur are compared null-safe in upserts; of several new rows with one key the last by
the order column holds; empty changes leave a table as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """old with the rows of new: those of known keys replace (or, without update, lose), the others are added."""
    named = lambda d: d.select(*keys).distinct().withColumnsRenamed({k: f"_k_{k}" for k in keys})
    apart = lambda a, b: a.join(named(b), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left_anti")
    return apart(old, new).unionByName(new) if update else old.unionByName(apart(new, old))


def update_from(df: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with columns taken from source where it has a row and a value for the key."""
    s = source.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    out = df.join(s, keys, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def delete_using(df: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(doomed.select(*keys).distinct(), keys, "left_anti")


def keep_first(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """One row of each key: the first by order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def flattened(df: DataFrame, separator: str = "; ") -> DataFrame:
    """df for a text export: arrays joined, nulls empty."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "array":
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), separator)
        cols.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*cols)


def export_csv(df: DataFrame, path: str) -> None:
    flattened(df).write.mode("overwrite").option("header", "true").csv(path)


def reconcile(existing: DataFrame, seed: DataFrame, key: list[str], fields: list[str], owned: tuple[str, ...] = (), tolerance: float = 1e-9) -> DataFrame:
    """(key, field, action, old, new): what a seed would do to each field: insert, fill_blank, code_update (a field that the
    seed owns), conflict or noop; numbers are alike within a relative tolerance."""
    o = existing.select(*key, F.lit(1).alias("_there"), *(F.col(f).alias(f"_{f}") for f in fields))
    j = seed.select(*key, *fields).join(o, key, "left")
    rows = []
    for f in fields:
        old, new = F.col(f"_{f}"), F.col(f)
        same = old.eqNullSafe(new)
        if seed.schema[f].dataType.typeName() in ("double", "float"):
            same = same | (F.abs(old - new) <= tolerance * F.greatest(F.abs(old), F.abs(new)))
        blank = old.isNull() | (old.cast("string") == "")
        action = F.when(F.col("_there").isNull(), "insert").when(new.isNull() | F.coalesce(same, F.lit(False)), "noop").when(blank, "fill_blank").when(F.lit(f in owned), "code_update").otherwise("conflict")
        rows.append(F.struct(F.lit(f).alias("field"), action.alias("action"), old.cast("string").alias("old"), new.cast("string").alias("new")))
    return j.select(*key, F.explode(F.array(*rows)).alias("x")).select(*key, "x.*")
