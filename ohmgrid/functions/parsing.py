"""Expressions that read conditions out of file names, paths and notes: ordered alternatives, the first that fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(c: Column, *patterns: str) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns))


def chip(c: Column) -> Column:
    """`W05_C38` of a name or path, in capitals with two digits at least."""
    w, n = _first(c, r"(?i)(?:^|[^A-Za-z0-9])W([0-9]+)[_ -]?C[0-9]+"), _first(c, r"(?i)(?:^|[^A-Za-z0-9])W[0-9]+[_ -]?C([0-9]+)")
    return F.when(w.isNotNull(), F.concat(F.lit("W"), F.lpad(w, F.greatest(F.length(w), F.lit(2)), F.lit("0")), F.lit("_C"), F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0"))))


def bias(c: Column) -> Column:
    """Volts named in a file name: `_50V_`, `Vg-10`, `800V10us`."""
    return _first(c, r"(?i)_(-?[0-9.]+)V[_.]", r"(?i)vg[ =_]*(-?[0-9.]+)", r"(?i)([0-9.]+)V[0-9]").try_cast("double")


def temperature(c: Column) -> Column:
    """Degrees Celsius: `25C`, `25 °C`, `RT` is 25."""
    return F.coalesce(_first(c, r"(?i)(?:^|[^A-Za-z0-9])(-?[0-9]+(?:\.[0-9]+)?) ?(?:°C|degC|C(?![A-Za-z0-9]))").try_cast("double"), F.when(F.rlike(c, F.lit(r"(?i)(^|[^A-Za-z])RT([^A-Za-z]|$)")), 25.0))


def pulse(c: Column) -> Column:
    """Number of the pulse or shot: `pulse12`, `shot_3`, a folder `3_after...`."""
    return _first(c, r"(?i)(?:pulse|shot)[ _-]?([0-9]+)", r"(?i)(?:^|/)([0-9]+)_after").try_cast("int")


#: Categories and the expression that a name of them matches, in order.
CATEGORIES = [
    ("IdVg", r"(?i)id[ _-]?vg|transfer"), ("IdVd", r"(?i)id[ _-]?vd(?!ss)|output"), ("Blocking", r"(?i)block|bvdss|idvdss"), ("Igss", r"(?i)igss|gate[ _-]?leak"),
    ("Rdson", r"(?i)rds[ _-]?\(?on"), ("Vth", r"(?i)vth|threshold"), ("Irradiation", r"(?i)irrad|beam"),
]


def category(c: Column) -> Column:
    out = F.lit("Other")
    for name, p in reversed(CATEGORIES):
        out = F.when(F.rlike(c, F.lit(p)), name).otherwise(out)
    return F.when(c.isNotNull(), out)


def avalanche_counter(name: Column, known: Column) -> Column:
    """(index, basis) of a pulse: the known index, else the counter behind `Vg` in a file's name (its last five digits), or
    the five digits and more behind a current `..A`; null without one."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    gate = F.get(F.filter(F.regexp_extract_all(stem, F.lit(r"(?i)Vg([^_/\\.]+)"), F.lit(1)), lambda t: F.rlike(t, F.lit("^[+-]?[0-9]{6,}$"))), F.lit(0))
    current = F.nullif(F.regexp_extract(stem, r"(?i)(?:^|_)[0-9]+(?:[p.][0-9]+)?A([0-9]{5,})(?:_|$)", 1), F.lit(""))
    return _counter((known, "avalanche_shot_index_metadata"), (F.right(gate, F.lit(5)), "avalanche_filename_vg_counter"), (current, "avalanche_filename_current_counter"))


def sc_counter(path: Column, known: Column) -> Column:
    """(index, basis) of a pulse: the known index, else the number behind `pulse`, or in front of `_after<n>V`; null without."""
    space = F.concat(F.lit("/"), F.translate(path, "\\", "/"))
    pulse = F.nullif(F.regexp_extract(space, r"(?i)(?:^|[^A-Za-z0-9])pulse[_-]?([0-9]+)(?:[^A-Za-z0-9]|$)", 1), F.lit(""))
    after = F.nullif(F.regexp_extract(space, r"(?i)(?:^|/)([0-9]+)_after[0-9]+V", 1), F.lit(""))
    return _counter((known, "sc_sequence_num_metadata"), (pulse, "sc_filename_pulse_counter"), (after, "sc_filename_after_counter"))


def _counter(*found: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(c.isNotNull(), F.struct(c.try_cast("int").alias("index"), F.lit(basis).alias("basis"))) for c, basis in found))
