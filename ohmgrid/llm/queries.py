"""Queries p3, p4, p6, p8, p9 and p10, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.llm import batch_dedup, canonical, mixing, quantiles, shared_spans, tokenizer
from ohmgrid.session import join_dimension
from ohmgrid.tables import table


#: Loads in which the queries replay the log of arrivals; the result is the same for any number.
LOADS = 10


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All ingest batches one after another (more than LOADS: in LOADS runs of batches), each against the store that the
    earlier ones left."""
    return batch_dedup.accept_all(table(spark, d, "baselines_metadata"), loads=LOADS).repeats()


def p3_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rows and repeats of each ingest batch."""
    files = table(spark, d, "baselines_metadata")
    again = batch_dedup.accept_all(files, loads=LOADS).repeats().select(F.col("id_b").alias("id"), F.lit(1).alias("again"))
    return files.select("id", "ingest_batch").join(again, "id", "left").groupBy("ingest_batch").agg(F.count("*").alias("files"), F.count("again").alias("repeats"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_parts(table(spark, d, "baselines_metadata"), table(spark, d, "device_library"), table(spark, d, "device_mapping_rules"))


GROUPS = ["measurement_category", "field_name"]


def p6_digests(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of one digest per category, field and ingest batch."""
    by = [*GROUPS, "ingest_batch"]
    return quantiles.merge(quantiles.digest(quantiles.measured(table(spark, d, "baselines_measurements"), table(spark, d, "baselines_metadata")), by), by)


def p6_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, 90th and 99th percentile of each category and field, from the merged digests of the ingest batches."""
    by = [*GROUPS, "ingest_batch"]
    parts = quantiles.digest(quantiles.measured(table(spark, d, "baselines_measurements"), table(spark, d, "baselines_metadata")), by)
    return quantiles.quantiles(quantiles.merge(parts, GROUPS), GROUPS)


def p6_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile's rank among all values is within the bound, a value being kept to one part in a million."""
    values = quantiles.measured(table(spark, d, "baselines_measurements"), table(spark, d, "baselines_metadata"))
    values = values.filter((F.abs("value") < quantiles.LIMIT) & ~F.isnan("value"))
    group = F.concat_ws("|", F.coalesce("measurement_category", F.lit("?")), "field_name").alias("g")
    found = p6_quantiles(spark, d).select(group, "q", F.col("value").alias("at"), "n")
    j = join_dimension(values.select(*GROUPS, "value", group), found, "g")
    near, off = F.abs("at") * 1e-6, F.col("n") * quantiles.EPSILON
    ranks = j.groupBy(*GROUPS, "q", "n").agg(F.count_if(F.col("value") < F.col("at") - near).alias("below"), F.count_if(F.col("value") <= F.col("at") + near).alias("upto"))
    inside = (F.col("below") - off <= F.col("q") * F.col("n")) & (F.col("upto") + off >= F.col("q") * F.col("n"))
    return ranks.select(*GROUPS, "q", "n", inside.alias("inside"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.round_trip(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p9_feasible_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the largest mix in which every source with documents reaches its target."""
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets, tokens="feasible"), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.SharedSpans(table(spark, d, "documents")).pairs()


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.SharedSpans(table(spark, d, "documents")).spans()


def p10_portions(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.SharedSpans(table(spark, d, "documents")).portions()


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the class of its exact copies."""
    return shared_spans.SharedSpans(table(spark, d, "documents")).classes()


def p10_sets(spark: SparkSession, d: str) -> DataFrame:
    """The sets of unlike documents (by the first of their copies) that hold one stretch, each member a row."""
    return shared_spans.SharedSpans(table(spark, d, "documents")).members()


QUERIES = {
    "p3_found": p3_found, "p3_batches": p3_batches, "p4_found": p4_found, "p6_quantiles": p6_quantiles, "p6_digests": p6_digests, "p6_ranks": p6_ranks,
    "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_feasible_shares": p9_feasible_shares, "p10_found": p10_found, "p10_spans": p10_spans,
    "p10_portions": p10_portions, "p10_classes": p10_classes, "p10_sets": p10_sets,
}
P3_SQL = r"""
WITH RECURSIVE f AS (SELECT id, regexp_replace(lower(replace(url_decode(replace(csv_path, '+', '%2B')), chr(92), '/')), '[\s_-]+', '_', 'g') AS p, nullif(regexp_replace(lower(trim(file_hash)), '^md5:', ''), '') AS h FROM baselines_metadata WHERE coalesce(num_points, 1) <> 0),
k AS (SELECT id, CASE WHEN h <> 'd41d8cd98f00b204e9800998ecf8427e' THEN 'h' || h END AS h, CASE WHEN regexp_matches(p, '_[0-9]{4}_[0-9]{6}/') AND regexp_matches(p, '/[0-9]{8}_[a-z]+/') AND regexp_matches(p, '/w[0-9]+_c[0-9]+_[a-z]+_[a-z]+_[0-9]+v_[0-9]+[^/]*$')
    THEN regexp_extract(p, '_([0-9]{4}_[0-9]{6})/', 1) || regexp_extract(p, '/([0-9]{8}_[a-z]+)/', 1) || regexp_extract(p, '/(w[0-9]+_c[0-9]+_[a-z]+_[a-z]+_[0-9]+v_[0-9]+)[^/]*$', 1) ELSE regexp_extract(p, '([^/.]*)[^/]*$', 1) END AS p FROM f),
node AS (SELECT id, h AS key FROM k WHERE h IS NOT NULL UNION ALL SELECT id, 'p' || p FROM k WHERE p IS NOT NULL AND p <> ''),
link AS (SELECT DISTINCT a.id AS u, b.id AS v FROM node a JOIN node b ON a.key = b.key AND a.id <> b.id),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT min(v) AS id_a, u AS id_b FROM reach WHERE u <> v GROUP BY u HAVING min(v) < u
"""

P3_BATCHES_SQL = P3_SQL.replace("SELECT min(v) AS id_a", ", again AS (SELECT min(v) AS id_a") + ") SELECT ingest_batch, count(*) AS files, count(id_b) AS repeats FROM baselines_metadata LEFT JOIN again ON id = id_b GROUP BY 1"

P4_SQL = r"""
WITH t AS (SELECT DISTINCT device_id, coalesce(data_source, 'baselines') AS source FROM baselines_metadata WHERE trim(device_id) <> '' AND device_id NOT IN (SELECT part_number FROM device_library)),
a AS (SELECT device_id, source, regexp_replace(upper(trim(device_id)), '([ _-]*#[ ]*[0-9]+|[ _-]*[(]NO[.]? ?[0-9]+[)]|[ _-]+SAMPLE ?[0-9]+|_S[0-9][0-9]?|[ _-]+DUT ?[0-9]+|[ _-]+DIE ?[0-9]+)\s*$', '') AS s FROM t),
b AS (SELECT device_id, source, regexp_replace(regexp_replace(s, '^((CARRIER|BOARD|OLD)[ _-]+)+', ''), '^(TESSARAC|NORDHELM|QUILLON|VARROWEN|OSMERE)( DEVICES| SEMI| POWER| ELECTRIC)?[ _:-]+', '') AS s FROM a),
c AS (SELECT *, regexp_replace(s, '[ _.,:;/-]+', '', 'g') AS q FROM b), l AS (SELECT part_number, regexp_replace(upper(part_number), '[ _.,:;/-]+', '', 'g') AS e FROM device_library),
r AS (SELECT c.device_id, c.source, x.part_number, row_number() OVER (PARTITION BY c.device_id, c.source ORDER BY x.priority DESC, length(x.pattern) DESC, x.id) AS n FROM c JOIN device_mapping_rules x
  ON (x.scope = 'all' OR c.source = CASE x.scope WHEN 'sc' THEN 'sc_ruggedness' ELSE x.scope END) AND CASE x.pattern_type WHEN 'substring' THEN contains(q, regexp_replace(upper(x.pattern), '[ _.,:;/-]+', '', 'g')) ELSE regexp_matches(s, '(?i)' || x.pattern) OR regexp_matches(q, '(?i)' || x.pattern) END),
d AS (SELECT q, part_number, levenshtein(q, e) AS n FROM (SELECT DISTINCT q FROM c) JOIN l ON abs(length(q) - length(e)) <= 2 WHERE levenshtein(q, e) <= 2), m AS (SELECT q, min(n) AS n FROM d GROUP BY 1),
o AS (SELECT d.q, min(part_number) AS part_number FROM d JOIN m ON d.q = m.q AND d.n = m.n GROUP BY 1 HAVING count(*) = 1),
z AS (SELECT c.device_id, c.source, coalesce(r.part_number, o.part_number, 'UNMATCHED') AS part_number FROM c LEFT JOIN r ON r.device_id = c.device_id AND r.source = c.source AND r.n = 1 LEFT JOIN o ON o.q = c.q)
SELECT f.id AS metadata_id, z.part_number FROM baselines_metadata f JOIN z ON f.device_id = z.device_id AND coalesce(f.data_source, 'baselines') = z.source
"""

#: Every stretch of 200 characters of every text; holds up to the middle scale.
P10_SQL = """
WITH w AS (SELECT DISTINCT doc_id, md5(substring(text, k, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS k FROM documents WHERE length(text) >= 200)),
g AS (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1), s AS (SELECT w.* FROM w JOIN g USING (h))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id
"""

P10_CLASSES_SQL = """
SELECT DISTINCT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS copies FROM (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200) WINDOW w AS (PARTITION BY text)
"""
#: Begins of shared stretches no more than 200 apart are one stretch; the whole of a text that has an exact copy.
P10_SPANS_SQL = """
WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200), c AS (SELECT text FROM t GROUP BY 1 HAVING count(*) > 1),
w AS (SELECT doc_id, k, md5(substring(text, k, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS k FROM t)),
s AS (SELECT doc_id, k FROM w WHERE h IN (SELECT h FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1) AND doc_id NOT IN (SELECT doc_id FROM t JOIN c USING (text))),
b AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 200 THEN 0 ELSE 1 END AS begins FROM s), i AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM b),
r AS (SELECT doc_id, CAST(min(k) - 1 AS INT) AS start, max(k) - min(k) + 200 AS length FROM i GROUP BY doc_id, island UNION ALL SELECT doc_id, 0, length(text) FROM t JOIN c USING (text))
"""
P10_PORTIONS_SQL = P10_SPANS_SQL + """, n AS (SELECT doc_id, max(length(text)) AS n_chars FROM t GROUP BY 1), o AS (SELECT doc_id, sum(length) AS shared FROM r GROUP BY 1)
SELECT doc_id, n_chars, coalesce(shared, 0) AS shared_chars, coalesce(shared, 0) / n_chars AS portion FROM n LEFT JOIN o USING (doc_id)"""
P10_SPANS_SQL += "SELECT doc_id, start, length FROM r"

#: Every percentile of every category and field is within the bound.
P6_RANKS_SQL = """
WITH v AS (SELECT measurement_category, unnest(['rds', 'bv']) AS field_name, unnest([rds, bv]) AS value FROM baselines_measurements p JOIN baselines_metadata f ON f.id = p.metadata_id)
SELECT measurement_category, field_name, unnest([0.5, 0.9, 0.99]::DOUBLE[]) AS q, count(*) AS n, true AS inside FROM v WHERE abs(value) < 1e30 AND NOT isnan(value) GROUP BY measurement_category, field_name
"""

SQL: dict[str, str] = {"p6_ranks": P6_RANKS_SQL, "p3_found": P3_SQL, "p3_batches": P3_BATCHES_SQL, "p4_found": P4_SQL, "p10_found": P10_SQL, "p10_spans": P10_SPANS_SQL, "p10_portions": P10_PORTIONS_SQL, "p10_classes": P10_CLASSES_SQL}
