"""Free-typed values to a canonical list by a partition-based pigeonhole join, in SQL only.

Two strings within K edits share, unchanged and shifted by at most K, one of any K + 1 segments of one of them. Each
canonical entry is cut into K + 1 segments; a typed value gives the substrings that stand at those positions, shifted by
-K to K, for every length an entry may have; equal segments meet in a hash join, and levenshtein verifies. Entries of K
characters or fewer have empty segments, which all values of at most 2 K characters share. Only distinct
typed values are compared, so a value typed in a third of all rows is compared once. Rules (a fixed, small table) come
first, as an array in a scalar subquery. What nothing fits is reported through an anti-join.

Defined results: null and blank values and values that literally are an entry are left out; a value with two entries
equally near is UNMATCHED, and so is one further than K edits from all; a null data_source is `baselines`; a null pattern,
priority or part_number of a rule makes it void; of rules equal in priority and length the one of the lowest id holds;
repeated rows are answered each; empty tables give an empty result (an empty list or no rules leave all UNMATCHED); extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ohmgrid.session import materialize

#: Most edits.
K = 2
#: Words before a value that name what carries the part, and marks of a sample at its end.
CARRIERS = "CARRIER|BOARD|OLD|SOCKET|PCB|HOLDER|FIXTURE"
SAMPLE = r"([ _-]*#[ ]*[0-9]+|[ _-]*[(]NO[.]? ?[0-9]+[)]|[ _-]+SAMPLE ?[0-9]+|_S[0-9][0-9]?|[ _-]+DUT ?[0-9]+|[ _-]+DIE ?[0-9]+)\\s*$"
SEPARATORS = r"[\\s_.,:;/-]+"

TYPED = """
SELECT DISTINCT f.device_id, coalesce(f.data_source, 'baselines') AS source
FROM {files} f LEFT ANTI JOIN {library} l ON f.device_id = l.part_number
WHERE trim(f.device_id) <> ''
"""

#: Without sample mark, carrier words and maker; folded: without separators as well.
FORMS = rf"""
WITH a AS (SELECT DISTINCT device_id, regexp_replace(upper(trim(device_id)), '{SAMPLE}', '') AS s FROM {{typed}}),
b AS (SELECT device_id, regexp_replace(s, '^(({CARRIERS})[ _-]+)+', '') AS s,
             (SELECT collect_set(m) FROM (SELECT upper(manufacturer) AS m FROM {{library}} UNION SELECT upper(split(manufacturer, ' ')[0]) FROM {{library}}) WHERE m <> '') AS makers FROM a),
c AS (SELECT device_id, s, array_max(transform(filter(makers, m -> startswith(s, m) AND length(s) > length(m) AND substr(s, length(m) + 1, 1) IN (' ', '_', '-', ':')), m -> length(m))) AS cut FROM b),
d AS (SELECT device_id, regexp_replace(regexp_replace(CASE WHEN cut IS NULL THEN s ELSE substr(s, cut + 1) END, '^[ _:-]+', ''), '^(({CARRIERS})[ _-]+)+', '') AS s FROM c)
SELECT device_id, s, regexp_replace(s, '{SEPARATORS}', '') AS folded FROM d
"""

RULED = rf"""
WITH r AS (SELECT CASE scope WHEN 'sc' THEN 'sc_ruggedness' ELSE scope END AS scope,
             array_sort(collect_list(struct(-priority AS p, -length(pattern) AS l, id, part_number, pattern_type, pattern, regexp_replace(upper(pattern), '{SEPARATORS}', '') AS folded))) AS rules
           FROM {{rules}} WHERE pattern <> '' AND priority IS NOT NULL AND part_number IS NOT NULL AND scope IS NOT NULL GROUP BY 1),
e AS (SELECT t.device_id, t.source, f.s, f.folded, scope FROM {{typed}} t JOIN {{forms}} f ON t.device_id = f.device_id LATERAL VIEW explode(array('all', t.source)) x AS scope),
m AS (SELECT device_id, source, get(filter(rules, x ->
         CASE x.pattern_type WHEN 'substring' THEN contains(folded, x.folded)
                             WHEN 'regex' THEN s RLIKE concat('(?i)', x.pattern) OR folded RLIKE concat('(?i)', x.pattern) END), 0) AS hit
      FROM e LEFT JOIN r USING (scope))
SELECT device_id, source, best.part_number FROM (
  SELECT device_id, source, min(struct(hit.p, hit.l, hit.id, hit.part_number)) FILTER (WHERE hit IS NOT NULL) AS best FROM m GROUP BY device_id, source)
"""

#: Segment i (0 to K) of a string of n characters begins at i * n div (K + 1) + 1 and ends before the next one.
NEAREST = f"""
WITH ref AS (SELECT part_number, regexp_replace(upper(part_number), '{SEPARATORS}', '') AS folded FROM {{library}} WHERE part_number IS NOT NULL),
seg AS (SELECT part_number, folded, n, i, substr(folded, i * n div {K + 1} + 1, (i + 1) * n div {K + 1} - i * n div {K + 1}) AS piece
        FROM (SELECT *, length(folded) AS n FROM ref) LATERAL VIEW explode(sequence(0, {K})) x AS i WHERE n > 0),
q AS (SELECT DISTINCT folded FROM {{open}} WHERE folded <> ''),
probe AS (SELECT DISTINCT folded, n, i, substr(folded, CAST(i * n div {K + 1} + 1 + d AS INT), CAST((i + 1) * n div {K + 1} - i * n div {K + 1} AS INT)) AS piece
          FROM q LATERAL VIEW explode(sequence(length(folded) - {K}, length(folded) + {K})) y AS n
                 LATERAL VIEW explode(sequence(0, {K})) x AS i LATERAL VIEW explode(sequence(-{K}, {K})) z AS d
          WHERE n > 0 AND i * n div {K + 1} + 1 + d >= 1 AND (i + 1) * n div {K + 1} + d <= length(folded)),
pair AS (SELECT DISTINCT p.folded, s.part_number, s.folded AS entry FROM probe p JOIN seg s ON p.n = s.n AND p.i = s.i AND p.piece = s.piece),
near AS (SELECT folded, part_number, levenshtein(folded, entry, {K}) AS edits FROM pair),
best AS (SELECT folded, min(struct(edits, part_number)) AS least, min(edits) AS edits FROM near WHERE edits >= 0 GROUP BY folded)
SELECT b.folded, b.least.part_number AS part_number
FROM best b JOIN near n ON b.folded = n.folded AND b.edits = n.edits
GROUP BY b.folded, b.least.part_number HAVING count(*) = 1
"""

ANSWER = """
WITH fits AS (
  SELECT device_id, source, part_number FROM {ruled} WHERE part_number IS NOT NULL
  UNION ALL
  SELECT r.device_id, r.source, n.part_number FROM {ruled} r JOIN {forms} f ON r.device_id = f.device_id JOIN {nearest} n ON f.folded = n.folded WHERE r.part_number IS NULL),
every AS (
  SELECT * FROM fits
  UNION ALL
  SELECT t.device_id, t.source, 'UNMATCHED' FROM {typed} t LEFT ANTI JOIN fits x ON t.device_id = x.device_id AND t.source = x.source)
SELECT f.id AS metadata_id, e.part_number FROM {files} f JOIN every e ON f.device_id = e.device_id AND coalesce(f.data_source, 'baselines') = e.source
"""


def canonical_parts(files: DataFrame, library: DataFrame, rules: DataFrame) -> DataFrame:
    """(metadata_id, part_number or UNMATCHED) of every row whose device_id is neither blank nor literally an entry."""
    sql = files.sparkSession.sql
    typed = materialize(sql(TYPED, files=files, library=library), "typed")
    forms = materialize(sql(FORMS, typed=typed, library=library), "forms")
    ruled = materialize(sql(RULED, typed=typed, forms=forms, rules=rules), "ruled")
    open_ = sql("SELECT f.folded FROM {ruled} r JOIN {forms} f ON r.device_id = f.device_id WHERE r.part_number IS NULL", ruled=ruled, forms=forms)
    nearest = sql(NEAREST, open=open_, library=library)
    return sql(ANSWER, ruled=ruled, forms=forms, nearest=nearest, typed=typed, files=files)
