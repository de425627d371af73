"""Queries p1, p2, p5 and p7 over the measurement database, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.operators import control_chart, regrid, schema_drift, units
from ohmgrid.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "baselines_metadata"), table(spark, d, "file_samples"), table(spark, d, "header_names"))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, d, "baselines_metadata"), table(spark, d, "file_samples"), table(spark, d, "header_names"))


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table with a row for each cell."""
    c = schema_drift.consistent_cells(table(spark, d, "baselines_metadata"), table(spark, d, "file_samples"), table(spark, d, "header_names"))
    return c.groupBy("metadata_id", "row_no", "step", "field_name").agg(F.max("value").alias("value"))


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.versions(table(spark, d, "baselines_metadata"), table(spark, d, "file_samples"), table(spark, d, "header_names"))


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    return units.ratings(table(spark, d, "device_library"), "device_library", "id").unionByName(units.ratings(table(spark, d, "library_imports"), "library_imports", "import_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.in_base_units(_ratings(spark, d)).filter("value_base IS NOT NULL").select("table_name", "row_id", "field_name", "value_base")


def p2_aliases(spark: SparkSession, d: str) -> DataFrame:
    return units.alias_dictionary(units.spellings(_ratings(spark, d))).select("field_name", "spelling", "factor")


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Ratings whose unit fits no known name: they have no value and are not guessed."""
    return units.unmatched(_ratings(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return control_chart.implausible_readings(table(spark, d, "baselines_measurements"), table(spark, d, "baselines_metadata")).select("id", "field_name")


def p5_by_file(spark: SparkSession, d: str) -> DataFrame:
    """How many readings of each file and field are flagged, by reason."""
    m = table(spark, d, "baselines_measurements")
    hit = control_chart.implausible_readings(m, table(spark, d, "baselines_metadata"))
    return hit.join(m.select("id", "metadata_id"), "id").groupBy("metadata_id", "field_name", "reason").agg(F.count("*").alias("readings"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return regrid.missing_slots(table(spark, d, "baselines_measurements"), table(spark, d, "baselines_metadata"))


def p7_grid(spark: SparkSession, d: str) -> DataFrame:
    return regrid.regular_series(table(spark, d, "baselines_measurements"), table(spark, d, "baselines_metadata"))


def p7_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The grid from slot 0 to the number of points that a file announces, counted by status."""
    files = table(spark, d, "baselines_metadata")
    bounds = files.select(F.col("id").alias("metadata_id"), F.lit(0).alias("first_slot"), (F.col("num_points") - 1).alias("last_slot"))
    g = regrid.regular_series(table(spark, d, "baselines_measurements"), files, bounds)
    return g.groupBy("metadata_id", "status").agg(F.count("*").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"))


P7_SQL = """
WITH s AS (
  SELECT DISTINCT p.metadata_id, CAST(floor(p.time_val / m.delay_time) AS BIGINT) AS slot
  FROM baselines_measurements p JOIN baselines_metadata m ON m.id = p.metadata_id
  WHERE m.delay_time > 0 AND p.time_val IS NOT NULL AND abs(p.time_val) < 1e30 AND NOT isnan(p.time_val)),
n AS (SELECT metadata_id, slot, lead(slot) OVER (PARTITION BY metadata_id ORDER BY slot) AS nxt FROM s)
SELECT metadata_id, unnest(range(slot + 1, nxt)) AS slot FROM n WHERE nxt - slot - 1 BETWEEN 1 AND 100
"""

P7_GRID = """
WITH v AS (SELECT p.metadata_id, m.delay_time AS dt, CAST(floor(p.time_val / m.delay_time) AS BIGINT) AS slot, p.time_val AS t, CASE WHEN abs(v_gate) < 1e30 THEN v_gate END AS v_gate, CASE WHEN abs(i_gate) < 1e30 THEN i_gate END AS i_gate, CASE WHEN abs(v_drain) < 1e30 THEN v_drain END AS v_drain, CASE WHEN abs(i_drain) < 1e30 THEN i_drain END AS i_drain
  FROM baselines_measurements p JOIN baselines_metadata m ON m.id = p.metadata_id WHERE m.delay_time > 0 AND abs(p.time_val) < 1e30 AND NOT isnan(p.time_val)),
o AS (SELECT *, row_number() OVER (PARTITION BY metadata_id, slot ORDER BY t, v_gate NULLS FIRST, i_gate NULLS FIRST, v_drain NULLS FIRST, i_drain NULLS FIRST) AS f, row_number() OVER (PARTITION BY metadata_id, slot ORDER BY t DESC, v_gate DESC NULLS LAST, i_gate DESC NULLS LAST, v_drain DESC NULLS LAST, i_drain DESC NULLS LAST) AS l FROM v),
a AS (SELECT * FROM o WHERE l = 1), b AS (SELECT * FROM o WHERE f = 1),
n AS (SELECT a.*, lead(a.slot) OVER w AS nxt, lead(b.t) OVER w AS nt, lead(b.v_gate) OVER w AS nv_gate, lead(b.i_gate) OVER w AS ni_gate, lead(b.v_drain) OVER w AS nv_drain, lead(b.i_drain) OVER w AS ni_drain FROM a JOIN b ON b.metadata_id = a.metadata_id AND b.slot = a.slot WINDOW w AS (PARTITION BY a.metadata_id ORDER BY a.slot)),
m AS (SELECT *, unnest(range(slot + 1, nxt)) AS s FROM n WHERE nxt > slot + 1), k AS (SELECT *, (dt * s - t) / (nt - t) AS w, nxt - slot - 1 <= 100 AS fill FROM m),
g AS (SELECT metadata_id, slot, dt * slot AS grid_time, 'read' AS status, v_gate, i_gate, v_drain, i_drain FROM a UNION ALL SELECT metadata_id, s, dt * s, CASE WHEN fill THEN 'filled' ELSE 'pause' END, CASE WHEN fill THEN v_gate + w * (nv_gate - v_gate) END, CASE WHEN fill THEN i_gate + w * (ni_gate - i_gate) END, CASE WHEN fill THEN v_drain + w * (nv_drain - v_drain) END, CASE WHEN fill THEN i_drain + w * (ni_drain - i_drain) END FROM k)
"""
P7_GRID_SQL = P7_GRID + "SELECT * FROM g"
P7_BOUNDED_SQL = P7_GRID + """, e AS (SELECT metadata_id, min(slot) AS lo, max(slot) AS hi, any_value(num_points) AS np FROM a JOIN baselines_metadata f ON f.id = a.metadata_id GROUP BY 1)
SELECT metadata_id, status, count(*) AS slots, min(slot) AS first, max(slot) AS last FROM g GROUP BY ALL UNION ALL SELECT metadata_id, 'before', lo, 0, lo - 1 FROM e WHERE lo > 0 UNION ALL SELECT metadata_id, 'after', np - 1 - hi, hi + 1, np - 1 FROM e WHERE np - 1 > hi"""

P1_SQL = r"""
WITH h AS (SELECT id, experiment, measurement_category, measured_on, columns, CASE WHEN contains(columns, chr(9)) THEN chr(9) WHEN contains(columns, ';') THEN ';' WHEN contains(columns, '|') THEN '|' ELSE ',' END AS sep
  FROM baselines_metadata WHERE columns IS NOT NULL AND experiment IS NOT NULL AND measurement_category IS NOT NULL AND measured_on IS NOT NULL),
b AS (SELECT *, string_split(columns, sep) AS heads FROM h), n AS (SELECT lower(header_base) AS base, any_value(field_name) AS field_name FROM header_names GROUP BY 1),
fold AS (SELECT id, unnest(heads) AS head, generate_subscripts(heads, 1) AS k FROM b),
base AS (SELECT id, k, regexp_replace(lower(trim(regexp_replace(head, '\[[^\]]*\]|\([^)]*\)', '', 'g'))), '\s+', '_', 'g') AS base FROM fold),
named AS (SELECT DISTINCT experiment, measurement_category, measured_on, base, coalesce(field_name, base) AS field_name FROM base JOIN b USING (id) LEFT JOIN n USING (base) WHERE base <> ''),
f AS (SELECT experiment, measurement_category, measured_on, field_name, string_agg(base, '|' ORDER BY base) AS bases FROM named GROUP BY ALL),
parts AS (SELECT b.id, string_split(s.cells, b.sep) AS c FROM b JOIN file_samples s ON s.metadata_id = b.id WHERE len(string_split(s.cells, b.sep)) = len(b.heads)),
cell AS (SELECT id, trim(unnest(c)) AS v, generate_subscripts(c, 1) AS k FROM parts),
t AS (SELECT experiment, measurement_category, measured_on, coalesce(field_name, base) AS field_name, CASE WHEN bool_and(regexp_matches(v, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')) THEN 'number' ELSE 'text' END AS kind
  FROM cell JOIN base USING (id, k) JOIN b USING (id) LEFT JOIN n USING (base) WHERE v <> '' GROUP BY ALL),
g AS (SELECT f.*, t.kind FROM f LEFT JOIN t USING (experiment, measurement_category, measured_on, field_name)),
d AS (SELECT *, lag(measured_on) OVER (PARTITION BY experiment, measurement_category ORDER BY measured_on) AS before FROM (SELECT DISTINCT experiment, measurement_category, measured_on FROM f)),
l AS (SELECT g.* FROM g JOIN d USING (experiment, measurement_category, measured_on) WHERE before IS NOT NULL),
e AS (SELECT d.experiment, d.measurement_category, d.measured_on, g.field_name, g.bases, g.kind FROM d JOIN g ON g.experiment = d.experiment AND g.measurement_category = d.measurement_category AND g.measured_on = d.before),
c AS (SELECT experiment, measurement_category, measured_on, field_name, l.bases AS b1, e.bases AS b0, l.kind AS k1, e.kind AS k0 FROM l FULL JOIN e USING (experiment, measurement_category, measured_on, field_name)),
m AS (SELECT experiment, measurement_category, measured_on, string_agg(DISTINCT regexp_replace(lower(measurement_type), '[^a-z0-9]', '', 'g'), '|' ORDER BY regexp_replace(lower(measurement_type), '[^a-z0-9]', '', 'g')) AS t
  FROM baselines_metadata WHERE experiment IS NOT NULL AND measurement_category IS NOT NULL AND measured_on IS NOT NULL AND measurement_type IS NOT NULL GROUP BY ALL),
ml AS (SELECT *, lag(t) OVER (PARTITION BY experiment, measurement_category ORDER BY measured_on) AS t0 FROM m),
r AS (SELECT experiment, measurement_category, measured_on, field_name, 'added' AS change FROM c WHERE b0 IS NULL UNION ALL SELECT experiment, measurement_category, measured_on, field_name, 'removed' FROM c WHERE b1 IS NULL
  UNION ALL SELECT experiment, measurement_category, measured_on, field_name, 'renamed' FROM c WHERE b0 <> b1 UNION ALL SELECT experiment, measurement_category, measured_on, field_name, 'type_changed' FROM c WHERE k0 <> k1
  UNION ALL SELECT experiment, measurement_category, measured_on, 'measurement_type', 'renamed' FROM ml WHERE t0 <> t)
SELECT experiment, measurement_category, CAST(measured_on AS VARCHAR) AS measured_on, field_name, change FROM r
"""

#: Straight from header base to field, whatever the versions say.
P1_CELLS_SQL = r"""
WITH h AS (SELECT id, columns, CASE WHEN contains(columns, chr(9)) THEN chr(9) WHEN contains(columns, ';') THEN ';' WHEN contains(columns, '|') THEN '|' ELSE ',' END AS sep FROM baselines_metadata WHERE columns IS NOT NULL),
n AS (SELECT lower(header_base) AS base, any_value(field_name) AS field_name FROM header_names GROUP BY 1), p AS (SELECT id, row_no, unnest(string_split(columns, sep)) AS head, unnest(string_split(cells, sep)) AS cell FROM h JOIN file_samples ON metadata_id = id WHERE len(string_split(columns, sep)) = len(string_split(cells, sep))),
c AS (SELECT id, row_no, coalesce(try_cast(nullif(regexp_extract(head, '\(([0-9]+)\)', 1), '') AS INTEGER), 1) AS step, regexp_replace(lower(trim(regexp_replace(head, '\[[^\]]*\]|\([^)]*\)', '', 'g'))), '\s+', '_', 'g') AS base, trim(cell) AS cell FROM p WHERE trim(cell) <> '')
SELECT id AS metadata_id, row_no, step, field_name, max(try_cast(replace(regexp_extract(cell, '^[<>~]?\s*([+-]?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?)', 1), ',', '.') AS DOUBLE)) AS value FROM c JOIN n USING (base) GROUP BY ALL
"""
P1_VERSIONS_SQL = P1_SQL[: P1_SQL.index("d AS (SELECT *, lag(measured_on)")].rstrip().rstrip(",") + """, v AS (SELECT experiment, measurement_category, measured_on, string_agg(field_name || ':' || bases || ':' || coalesce(kind, '?'), ';' ORDER BY field_name) AS fields FROM g GROUP BY ALL)
SELECT experiment, measurement_category, CAST(measured_on AS VARCHAR) AS measured_on, row_number() OVER (PARTITION BY experiment, measurement_category ORDER BY measured_on) AS version, fields, md5(fields) AS fingerprint FROM v"""

#: The specification's grammar: an optional scale, then the quantity's unit.
P2_PARSED = r"""
WITH u AS (SELECT 'device_library' AS table_name, CAST(id AS BIGINT) AS row_id, notes, unnest(['voltage_rating', 'rdson_mohm', 'current_rating_a']) AS field_name, unnest([voltage_rating, rdson_mohm, current_rating_a]) AS raw FROM device_library
  UNION ALL SELECT 'library_imports', import_id, notes, unnest(['voltage_rating', 'rdson_mohm', 'current_rating_a']), unnest([voltage_rating, rdson_mohm, current_rating_a]) FROM library_imports),
a AS (SELECT *, trim(regexp_replace(raw, '(?i)\s*(@|\(|\bat\b).*$', '')) AS txt FROM u),
b AS (SELECT *, regexp_extract(txt, '^[^0-9]*?([+-]?[0-9][0-9 .,]*(?:[eE][+-]?[0-9]+)?)', 1) AS num, lower(regexp_extract(txt, '^[^0-9]*?[+-]?[0-9][0-9 .,]*(?:[eE][+-]?[0-9]+)?\s*(\S*)', 1)) AS unit,
  lower(rtrim(CASE field_name WHEN 'voltage_rating' THEN regexp_extract(notes, '(?i)voltage[^;,/]*?\b(?:in|as)\s+([^\s;,/]+)', 1) WHEN 'rdson_mohm' THEN regexp_extract(notes, '(?i)(?:on-resistance|rds\(on\))[^;,/]*?\b(?:in|as)\s+([^\s;,/]+)', 1)
    ELSE regexp_extract(notes, '(?i)(?:current|\bif\b)[^;,/]*?\b(?:in|as)\s+([^\s;,/]+)', 1) END, '.')) AS said FROM a),
c AS (SELECT *, try_cast(replace(regexp_replace(regexp_replace(regexp_replace(num, ' ', '', 'g'), ',([0-9]{3})(,|[.eE]|$)', '\1\2', 'g'), ',([0-9]{3})([.eE]|$)', '\1\2', 'g'), ',', '.') AS DOUBLE) AS v,
  coalesce(nullif(unit, ''), nullif(said, '')) AS spelling, replace(replace(replace(replace(coalesce(nullif(unit, ''), nullif(said, '')), 'µ', 'u'), 'μ', 'u'), 'ω', 'ohm'), '-', '') AS x FROM b),
g AS (SELECT *, CASE field_name WHEN 'voltage_rating' THEN '^(k|kilo|m|milli|u|micro|)(v|vdc|volts?)$' WHEN 'rdson_mohm' THEN '^(k|kilo|m|milli|u|micro|)(ohms?|r)$' ELSE '^(k|kilo|m|milli|u|micro|)(a|adc|amps?|amperes?)$' END AS rule FROM c),
d AS (SELECT *, CASE WHEN x IS NULL THEN CASE field_name WHEN 'rdson_mohm' THEN 1e-3 ELSE 1 END WHEN regexp_matches(x, rule) THEN CASE regexp_extract(x, rule, 1) WHEN '' THEN 1 WHEN 'k' THEN 1e3 WHEN 'kilo' THEN 1e3 WHEN 'm' THEN 1e-3 WHEN 'milli' THEN 1e-3 ELSE 1e-6 END END
  * CASE field_name WHEN 'rdson_mohm' THEN 1e6 ELSE 1e3 END AS factor FROM g)
"""
P2_SQL = P2_PARSED + "SELECT table_name, row_id, field_name, CAST(round(v * factor) AS BIGINT) AS value_base FROM d WHERE v IS NOT NULL AND factor IS NOT NULL"
P2_UNMATCHED_SQL = P2_PARSED + "SELECT table_name, row_id, field_name, raw, spelling FROM d WHERE v IS NOT NULL AND factor IS NULL"
P2_ALIASES_SQL = P2_PARSED.replace("FROM g)", "FROM g), y AS (SELECT field_name, rule, unnest([unit, said]) AS spelling FROM g WHERE v IS NOT NULL), z AS (SELECT DISTINCT field_name, rule, replace(replace(replace(spelling, 'µ', 'u'), 'μ', 'u'), 'ω', 'ohm') AS spelling FROM y WHERE spelling <> '')") + """
SELECT field_name, spelling, CASE regexp_extract(replace(spelling, '-', ''), rule, 1) WHEN '' THEN 1 WHEN 'k' THEN 1e3 WHEN 'kilo' THEN 1e3 WHEN 'm' THEN 1e-3 WHEN 'milli' THEN 1e-3 ELSE 1e-6 END * CASE field_name WHEN 'rdson_mohm' THEN 1e6 ELSE 1e3 END AS factor
FROM z WHERE regexp_matches(replace(spelling, '-', ''), rule)
"""

QUERIES = {
    "p1_found": p1_found, "p1_table": p1_table, "p1_cells": p1_cells, "p1_versions": p1_versions, "p2_found": p2_found, "p2_aliases": p2_aliases, "p2_unmatched": p2_unmatched,
    "p5_found": p5_found, "p5_by_file": p5_by_file, "p7_found": p7_found, "p7_grid": p7_grid, "p7_bounded": p7_bounded,
}
SQL = {"p1_found": P1_SQL, "p1_cells": P1_CELLS_SQL, "p1_versions": P1_VERSIONS_SQL, "p2_found": P2_SQL, "p2_aliases": P2_ALIASES_SQL, "p2_unmatched": P2_UNMATCHED_SQL, "p7_found": P7_SQL, "p7_grid": P7_GRID_SQL, "p7_bounded": P7_BOUNDED_SQL}
