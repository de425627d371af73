"""Drifting file schemas: versioned fingerprints, explicit migration steps, and one consistent table out of every file.

Each measuring date of one (experiment, measurement_category) is a version: its fields, the base name each has there, and
whether its cells are plain numbers. Their digest is the version's fingerprint. Only where it differs from that of the
version before are the two compared, field by field, and the steps between them (added, removed, renamed, type_changed)
are rows. A file is routed from its own version through every later step of its fields, in order, to the names of the
last version, and from there to header_names: rename, cast and default rules are applied one after another and recorded
with the row. A file without a version goes to header_names directly.

Defined results: files with null columns have no version and no row in the table; null experiment, category or date takes
a file out of the versions but not out of the table; a header base outside header_names is its own field in the versions
and is left out of the table; a sample row whose cells don't match its header in number gives no evidence of type and no
values; blank cells are null; a field without a non-blank cell on one of two dates is never type_changed; repeated files
change nothing; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmgrid.session import materialize

#: Delimiters of header texts in order of precedence, each as the regular expression that splits at it.
DELIMITERS = ("\t", ";", "[|]", ",")
PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
VERSION = ("experiment", "measurement_category")


def _delimiter(c: Column) -> Column:
    out = F.lit(DELIMITERS[-1])
    for d in reversed(DELIMITERS[:-1]):
        out = F.when(F.contains(c, F.lit(d.strip("[]"))), F.lit(d)).otherwise(out)
    return out


def header_base(h: Column) -> Column:
    """The base name of one header: no units in brackets, no step number, no case, `_` for inner blanks."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(h, r"\[[^\]]*\]|\([^)]*\)", ""))), r"\s+", "_")


def _headed(files: DataFrame) -> DataFrame:
    """metadata_id, version keys, delimiter and the array of headers (base, step) of each file with a header."""
    f = files.filter("columns IS NOT NULL").select(F.col("id").alias("metadata_id"), *VERSION, "measured_on", "columns", _delimiter(F.col("columns")).alias("delimiter"))
    return f.withColumn("raw", F.expr("split(columns, delimiter)")).withColumn(
        "headers",
        F.transform("raw", lambda h: F.struct(header_base(h).alias("base"), F.coalesce(F.regexp_extract(h, r"\(([0-9]+)\)", 1).try_cast("int"), F.lit(1)).alias("step"))),
    ).drop("raw", "columns")


def _names(names: DataFrame) -> DataFrame:
    return names.filter("header_base IS NOT NULL AND field_name IS NOT NULL").select(header_base(F.col("header_base")).alias("base"), F.col("field_name")).dropDuplicates(["base"])


def _split(headed: DataFrame, samples: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per cell, with its base and step."""
    s = samples.filter("cells IS NOT NULL").select("metadata_id", "row_no", "cells")
    split = headed.join(s, "metadata_id").withColumn("parts", F.expr("split(cells, delimiter)")).filter("size(parts) = size(headers)")
    flat = split.select("metadata_id", "row_no", *keep, F.explode(F.arrays_zip("headers", "parts")).alias("z"))
    return flat.select("metadata_id", "row_no", *keep, F.col("z.headers.base").alias("base"), F.col("z.headers.step").alias("step"), F.trim("z.parts").alias("cell")).filter("cell <> ''")


def fingerprint_fields(files: DataFrame, samples: DataFrame, names: DataFrame) -> DataFrame:
    """(experiment, measurement_category, measured_on, field_name, bases, cells, plain): each field of each version."""
    n = _names(names)
    headed = _headed(files).filter("experiment IS NOT NULL AND measurement_category IS NOT NULL AND measured_on IS NOT NULL")
    key = (*VERSION, "measured_on")
    named = headed.select(*key, F.explode(F.array_distinct(F.transform("headers", lambda h: h["base"]))).alias("base")).filter("base <> ''")
    named = named.join(n, "base", "left").withColumn("field_name", F.coalesce("field_name", "base"))
    bases = named.groupBy(*key, "field_name").agg(F.array_join(F.array_sort(F.collect_set("base")), "|").alias("bases"))
    cells = _split(headed, samples, key).groupBy(*key, "base").agg(F.count("*").alias("cells"), F.count_if(F.col("cell").rlike(PLAIN)).alias("plain"))
    cells = cells.join(n, "base", "left").withColumn("field_name", F.coalesce("field_name", "base")).groupBy(*key, "field_name").agg(F.sum("cells").alias("cells"), F.sum("plain").alias("plain"))
    return bases.join(cells, [*key, "field_name"], "left")


def _kind() -> Column:
    return F.when(F.col("cells") > 0, F.when(F.col("plain") == F.col("cells"), "number").otherwise("text"))


def fingerprints(files: DataFrame, samples: DataFrame, names: DataFrame) -> DataFrame:
    """(experiment, measurement_category, date, measured_on, version, fields, fingerprint): the versions in order of date,
    written once; fields is an array of (field_name, bases, kind)."""
    entry = F.struct("field_name", "bases", _kind().alias("kind"))
    v = fingerprint_fields(files, samples, names).groupBy(*VERSION, F.col("measured_on").alias("date")).agg(F.array_sort(F.collect_list(entry)).alias("fields"))
    text = F.array_join(F.transform("fields", lambda x: F.concat_ws(":", x["field_name"], x["bases"], F.coalesce(x["kind"], F.lit("?")))), ";")
    w = Window.partitionBy(*VERSION).orderBy("date")
    v = v.withColumn("text", text).withColumn("fingerprint", F.md5("text")).withColumn("version", F.row_number().over(w))
    return materialize(v.select(*VERSION, "date", F.date_format("date", "yyyy-MM-dd").alias("measured_on"), "version", "fields", "text", "fingerprint"), "versions")


def versions(files: DataFrame, samples: DataFrame, names: DataFrame) -> DataFrame:
    """(experiment, measurement_category, measured_on, version, fields, fingerprint): the versions in order of date."""
    return fingerprints(files, samples, names).select(*VERSION, "measured_on", "version", F.col("text").alias("fields"), "fingerprint")


def steps(versioned: DataFrame) -> DataFrame:
    """The migration steps to each version whose fingerprint is not that of the version before: (.., field_name, from_base,
    to_base, from_type, to_type, change)."""
    w = Window.partitionBy(*VERSION).orderBy("version")
    moved = versioned.withColumn("before", F.lag(F.struct("fields", "fingerprint")).over(w)).filter("before.fingerprint <> fingerprint")
    by_name = lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["field_name"], x)))
    every = F.array_union(F.transform("fields", lambda x: x["field_name"]), F.transform("before.fields", lambda x: x["field_name"]))
    moved = moved.select(*VERSION, "measured_on", "version", by_name("fields").alias("new"), by_name("before.fields").alias("old"), F.explode(every).alias("field_name"))
    both = moved.select(
        *VERSION, "measured_on", "version", "field_name", F.col("old")[F.col("field_name")]["bases"].alias("from_base"), F.col("new")[F.col("field_name")]["bases"].alias("to_base"),
        F.col("old")[F.col("field_name")]["kind"].alias("from_type"), F.col("new")[F.col("field_name")]["kind"].alias("to_type"),
    )
    change = F.array_compact(
        F.array(
            F.when(F.col("from_base").isNull(), "added"),
            F.when(F.col("to_base").isNull(), "removed"),
            F.when(F.col("from_base") != F.col("to_base"), "renamed"),
            F.when(F.col("from_type") != F.col("to_type"), "type_changed"),
        )
    )
    return both.withColumn("change", F.explode(change))


def routes(versioned: DataFrame) -> DataFrame:
    """(experiment, measurement_category, date, route): for each version, from each of its header bases to the base that
    the later steps lead to, with the rules applied on the way, as `rename old > new @ date`."""
    step = F.struct("version", "measured_on", "from_base", "to_base")
    chain = steps(versioned).filter("change = 'renamed'").groupBy(*VERSION, "field_name").agg(F.array_sort(F.collect_list(step)).alias("chain"))
    own = versioned.select(*VERSION, "date", "version", F.explode("fields").alias("f")).select(*VERSION, "date", "version", F.col("f.field_name").alias("field_name"), F.explode(F.split("f.bases", "[|]")).alias("base"))
    j = own.join(chain, [*VERSION, "field_name"], "left")
    later = F.filter(F.coalesce("chain", F.array().cast("array<struct<version:int,measured_on:string,from_base:string,to_base:string>>")), lambda x: x["version"] > F.col("version"))
    begin = F.struct(F.col("base").alias("base"), F.array().cast("array<string>").alias("rules"))

    def follow(acc: Column, x: Column) -> Column:
        to = F.get(F.split(x["to_base"], "[|]"), F.lit(0))
        rule = F.concat(F.lit("rename "), acc["base"], F.lit(" > "), to, F.lit(" @ "), x["measured_on"])
        moves = F.array_contains(F.split(x["from_base"], "[|]"), acc["base"]) & ~F.array_contains(F.split(x["to_base"], "[|]"), acc["base"])
        return F.when(moves, F.struct(to.alias("base"), F.array_append(acc["rules"], rule).alias("rules"))).otherwise(acc)

    routed = j.select(*VERSION, "date", F.struct("base", F.aggregate(later, begin, follow)).alias("r"))
    return routed.groupBy(*VERSION, "date").agg(F.map_from_entries(F.collect_list("r")).alias("route"))


def type_renames(files: DataFrame) -> DataFrame:
    """Changes of measurement_type beyond case and separators between consecutive dates that state one."""
    t = F.regexp_replace(F.lower("measurement_type"), "[^a-z0-9]", "")
    m = files.filter("experiment IS NOT NULL AND measurement_category IS NOT NULL AND measured_on IS NOT NULL AND measurement_type IS NOT NULL")
    by = m.groupBy(*VERSION, "measured_on").agg(F.array_join(F.array_sort(F.collect_set(t)), "|").alias("to_base"))
    by = by.withColumn("from_base", F.lag("to_base").over(Window.partitionBy(*VERSION).orderBy("measured_on")))
    return by.filter("from_base <> to_base").withColumn("field_name", F.lit("measurement_type")).withColumn("change", F.lit("renamed"))


def changes(files: DataFrame, samples: DataFrame, names: DataFrame) -> DataFrame:
    """The report: (experiment, measurement_category, measured_on, field_name, change)."""
    cols = [*VERSION, "measured_on", "field_name", "change"]
    renamed = type_renames(files).withColumn("measured_on", F.date_format("measured_on", "yyyy-MM-dd"))
    return steps(fingerprints(files, samples, names)).select(*cols).unionByName(renamed.select(*cols))


def consistent_cells(files: DataFrame, samples: DataFrame, names: DataFrame) -> DataFrame:
    """(metadata_id, row_no, step, field_name, value, rules) of every cell that isn't blank and whose base leads to a field
    of header_names; value is a double, null where the text holds no number."""
    found = routes(fingerprints(files, samples, names)).withColumnRenamed("date", "measured_on")
    headed = _headed(files).join(found, [*VERSION, "measured_on"], "left")
    to = F.transform("headers", lambda h: F.struct(h["step"].alias("step"), h["base"].alias("from"), F.coalesce(F.col("route")[h["base"]]["base"], h["base"]).alias("base"), F.col("route")[h["base"]]["rules"].alias("rules")))
    routed = headed.select("metadata_id", "delimiter", to.alias("headers"))
    s = samples.filter("cells IS NOT NULL").select("metadata_id", "row_no", "cells")
    split = routed.join(s, "metadata_id").withColumn("parts", F.expr("split(cells, delimiter)")).filter("size(parts) = size(headers)")
    flat = split.select("metadata_id", "row_no", F.explode(F.arrays_zip("headers", "parts")).alias("z"))
    c = flat.select("metadata_id", "row_no", F.col("z.headers.step").alias("step"), F.col("z.headers.base").alias("base"), F.col("z.headers.rules").alias("renames"), F.trim("z.parts").alias("cell")).filter("cell <> ''")
    c = c.join(_names(names), "base")
    number = F.regexp_replace(F.regexp_extract("cell", r"^[<>~]?\s*([+-]?(?:[0-9]+[.,]?[0-9]*|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), ",", ".").try_cast("double")
    last = F.when(F.col("base") != F.col("field_name"), F.concat(F.lit("rename "), "base", F.lit(" > "), "field_name"))
    cast = F.when(~F.col("cell").rlike(PLAIN), F.concat(F.lit("cast "), "field_name"))
    rules = F.concat(F.coalesce("renames", F.array().cast("array<string>")), F.array_compact(F.array(last, cast)))
    return c.select("metadata_id", "row_no", "step", "field_name", number.alias("value"), rules.alias("rules"))


def consistent_table(files: DataFrame, samples: DataFrame, names: DataFrame) -> DataFrame:
    """Every sample row of every file as (metadata_id, row_no, step, a double per field of header_names, rules)."""
    known = [r[0] for r in names.select("field_name").filter("field_name IS NOT NULL").distinct().orderBy("field_name").collect()]  # the columns of the result
    c = consistent_cells(files, samples, names)
    rows = c.groupBy("metadata_id", "row_no", "step").agg(
        *(F.max(F.when(F.col("field_name") == k, F.col("value"))).alias(k) for k in known), F.array_distinct(F.flatten(F.array_sort(F.collect_list("rules")))).alias("applied"), F.collect_set("field_name").alias("has")
    )
    default = F.transform(F.array_except(F.array(*map(F.lit, known)), "has"), lambda k: F.concat(F.lit("default "), k))
    return rows.withColumn("rules", F.array_join(F.concat("applied", F.array_sort(default)), "; ")).drop("applied", "has")
