"""Ratings written as text in mixed units: distinct unit spellings are mapped once, the dictionary is joined to all rows.

A rating is cut into number and unit spelling by JVM expressions. The distinct spellings meet the known unit names in an
inverted index of character bigrams; each candidate pair is verified by a weighted edit distance with transpositions, in
which plural, `dc`, hyphen and blank are cheap and the first letter, which may carry the scale, is dear. How far a
spelling may lie from a name grows with the name's length, and a spelling is refused unless it is nearer to its name, by
MARGIN, than to any name of another scale. The nearest verified name becomes the spelling's alias.

Defined results: null, blank and placeholder ratings state no quantity and give no row; a unit in the value holds before
one in notes, notes hold for a bare number, else V, mOhm or A; a word of WORDS behind the number is no unit; a spelling
that fits no known unit gives a null value_base and a row of unmatched(), never a default; of equally near names the one
first in UNITS holds; repeated rows give repeated results; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scales: symbol, spelled out, factor; and the base names of each field with what one of it is in base units.
SCALES = (("", "", 1.0), ("m", "milli", 1e-3), ("k", "kilo", 1e3), ("u", "micro", 1e-6))
BASES = {"voltage_rating": (("v", "volt"), 1e3), "rdson_mohm": (("ohm", "r"), 1e6), "current_rating_a": (("a", "amp", "ampere"), 1e3)}
#: Known names of units: field, name, how many base units (mV, uOhm, mA) it is.
UNITS = [
    (field, scale + base, of * factor)
    for field, (bases, of) in BASES.items()
    for base in bases
    for symbol, spelled, factor in SCALES
    for scale in dict.fromkeys((symbol, spelled))
    if not (scale and base == "r") and not (scale == spelled != "" and len(base) == 1)
]
#: Words behind a number that are no units.
WORDS = ("max", "min", "typ", "nom", "maximum", "minimum", "typical", "nominal", "rated", "continuous", "pulsed", "peak", "rms")
FIELDS = ("voltage_rating", "rdson_mohm", "current_rating_a")
DEFAULT = {"voltage_rating": 1e3, "rdson_mohm": 1e3, "current_rating_a": 1e3}
#: How notes name each rating.
SAID = {"voltage_rating": r"voltage|\bvdss?\b", "rdson_mohm": r"on-?\s?resistance|\brds\s*\(?on\)?", "current_rating_a": r"current|\bif\b|\bid\b"}

NUMBER = r"^[^0-9]*?([+-]?(?:[0-9]|[.,][0-9])(?:[0-9]|[   ](?=[0-9]{3}(?![0-9]))|[.,](?=[0-9]))*(?:[eE][+-]?[0-9]+)?)[   ]*(.*)$"
CONDITION = r"(?i)\s*(@|\(|\bat\b|\bbei\b|\bwhen\b).*$"
#: Cost of another first letter, or of one more in front; of plural, `dc`, hyphen or blank; how much nearer than any other scale.
FIRST, CHEAP, MARGIN = 2.0, 0.2, 0.79
#: Most that a spelling may differ, by the length of the name: only cheap edits, one letter, two letters.
NEAR = ((4, 0.65), (7, 1.25), (1 << 30, 2.25))


def ratings(df: DataFrame, table_name: str, key: str) -> DataFrame:
    """The three ratings of each row below each other: (table_name, row_id, field_name, raw, notes)."""
    pair = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("raw")) for f in FIELDS))).alias("x")
    return df.select(F.lit(table_name).alias("table_name"), F.col(key).cast("long").alias("row_id"), "notes", pair).select("table_name", "row_id", "x.field_name", "x.raw", "notes")


def _fold(c: Column) -> Column:
    """A spelling without marks that never matter: micro and ohm signs as letters, no case, no closing full stop."""
    out = F.lower(F.trim(c))
    for sign, letter in (("µ", "u"), ("μ", "u"), ("Ω", "ohm"), ("ω", "ohm"), ("ω", "ohm")):
        out = F.replace(out, F.lit(sign), F.lit(letter))
    out = F.regexp_replace(out, r"[.,;:]+$", "")
    return F.when(out.isin(*WORDS), "").otherwise(out)


def _parsed(rated: DataFrame) -> DataFrame:
    """rated plus value (as written), unit (spelling in the value) and said (spelling in notes for this rating)."""
    text = F.regexp_replace(F.trim("raw"), CONDITION, "")
    number = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, NUMBER, 1), r"[   ]", ""), r",(?=[0-9]{3}(?![0-9]))", "")
    said = F.lit(None).cast("string")
    for f, words in SAID.items():
        said = F.when(F.col("field_name") == f, F.regexp_extract("notes", rf"(?i)(?:{words})[^;,/]*?\b(?:in|as)\s+([^\s;,/]+)", 1)).otherwise(said)
    return rated.select(
        "*",
        F.replace(number, F.lit(","), F.lit(".")).try_cast("double").alias("value"),
        _fold(F.regexp_extract(F.regexp_extract(text, NUMBER, 2), r"^(\S*)", 1)).alias("unit"),
        _fold(said).alias("said"),
    ).filter("value IS NOT NULL AND NOT isnan(value)")


def spellings(rated: DataFrame) -> DataFrame:
    """The distinct (field_name, spelling) in values and notes."""
    return _parsed(rated).select("field_name", F.explode(F.array("unit", "said")).alias("spelling")).filter("spelling <> ''").distinct()


def weighted_distance(a: str, b: str) -> float:
    """Edit distance from spelling a to name b: CHEAP for s, d, c, hyphen and blank where they carry no scale, FIRST for a
    first letter put in front or changed, 1 for any other letter missing, added, changed or swapped with its neighbour."""
    cheap = lambda ch, i: ch in "-_ " or (i > 0 and ch in "sdc")
    extra = lambda i: CHEAP if cheap(a[i], i) else FIRST if i == 0 else 1.0
    missing = lambda j: CHEAP if cheap(b[j], j) else 1.0
    rows = [[0.0]]
    for j in range(len(b)):
        rows[0].append(rows[0][-1] + missing(j))
    for i, x in enumerate(a):
        own = [rows[i][0] + extra(i)]
        for j, y in enumerate(b):
            change = 0.0 if x == y else FIRST if i == j == 0 else 1.0
            best = min(rows[i][j] + change, rows[i][j + 1] + extra(i), own[-1] + missing(j))
            if i and j and x == b[j - 1] and a[i - 1] == y and x != y:
                best = min(best, rows[i - 1][j - 1] + 1.0)
            own.append(best)
        rows.append(own)
    return rows[-1][-1]


def near(name: str) -> float:
    """Most that a spelling may differ from a name."""
    return next(most for length, most in NEAR if len(name) < length)


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)], dtype="float64")


def _grams(c: str) -> Column:
    """Distinct bigrams of ^c$, hyphens and blanks left out."""
    bare = F.concat(F.lit("^"), F.regexp_replace(c, r"[-_ ]", ""), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(bare) - 1), lambda i: F.substring(bare, i, F.lit(2))))


def alias_dictionary(found: DataFrame) -> DataFrame:
    """(field_name, spelling, name, factor, distance): the nearest known unit of each spelling that has one."""
    rows = [(f, n, x, i, near(n)) for i, (f, n, x) in enumerate(UNITS)]
    known = found.sparkSession.createDataFrame(rows, "field_name string, name string, factor double, place int, near double")
    index = known.withColumn("gram", F.explode(_grams("name")))
    pairs = found.withColumn("gram", F.explode(_grams("spelling"))).join(index, ["field_name", "gram"]).drop("gram").distinct()
    pairs = pairs.withColumn("distance", _distance("spelling", "name"))
    best = pairs.groupBy("field_name", "spelling").agg(F.min(F.struct("distance", "place", "name", "factor", "near")).alias("b"), F.collect_list(F.struct("factor", "distance")).alias("all"))
    other = F.array_min(F.transform(F.filter("all", lambda x: x["factor"] != F.col("b.factor")), lambda x: x["distance"]))
    best = best.filter((F.col("b.distance") <= F.col("b.near")) & ((F.col("b.distance") == 0) | other.isNull() | (other - F.col("b.distance") > MARGIN)))
    return best.select("field_name", "spelling", "b.name", "b.factor", "b.distance")


def in_base_units(rated: DataFrame) -> DataFrame:
    """rated with value_base in mV, uOhm or mA, null where the unit is unknown; only rows that state a quantity."""
    p = _parsed(rated)
    alias = alias_dictionary(spellings(rated)).select("field_name", "spelling", "factor")
    for by in ("unit", "said"):
        p = p.join(alias.select("field_name", F.col("spelling").alias(by), F.col("factor").alias(f"{by}_factor")), ["field_name", by], "left")
    default = F.create_map(*(F.lit(x) for kv in DEFAULT.items() for x in kv))[F.col("field_name")]
    bare = F.coalesce(F.col("unit"), F.lit("")) == ""
    unsaid = F.coalesce(F.col("said"), F.lit("")) == ""
    p = p.withColumn("spelling", F.when(~bare, F.col("unit")).otherwise(F.col("said")))
    factor = F.when(~bare, F.col("unit_factor")).when(unsaid, default).otherwise(F.col("said_factor"))
    return p.withColumn("value_base", F.round(F.col("value") * factor).cast("long"))


def unmatched(rated: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, raw, spelling): ratings whose unit fits no known name."""
    return in_base_units(rated).filter("value_base IS NULL").select("table_name", "row_id", "field_name", "raw", "spelling")
