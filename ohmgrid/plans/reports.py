"""Queries over scored choices, rankings, flags and curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ohmgrid.functions import intervals
from ohmgrid.operators import bounds, cleaning, parameters, proxies, ranking
from ohmgrid.plans import laboratory
from ohmgrid.plans.base import Registry
from ohmgrid.sources import sinks

query = Registry()


def r(c, digits: int = 6):
    return F.round(c, digits)


@query("match_only_best", """
WITH s AS (SELECT a.id, b.id AS other, abs(a.num_points - b.num_points) AS score FROM baselines_metadata a JOIN baselines_metadata b ON a.experiment = b.experiment AND a.sample_group = b.sample_group AND a.measurement_category = b.measurement_category AND a.id <> b.id),
m AS (SELECT *, min(score) OVER (PARTITION BY id) AS least FROM s) SELECT id, min(other) AS other, least AS score FROM m WHERE score = least GROUP BY id, least HAVING count(*) = 1""")
def _(t):
    f = t("baselines_metadata").filter("num_points IS NOT NULL").select("id", "experiment", "sample_group", "measurement_category", "num_points")
    o = f.withColumnsRenamed({"id": "other", "num_points": "n"})
    s = f.join(o, ["experiment", "sample_group", "measurement_category"]).filter("id <> other").withColumn("score", F.abs(F.col("num_points") - F.col("n")))
    return ranking.only_best(s, ["id"], "score").select("id", "other", "score")


@query("match_strict_or_wide", """
WITH x AS (SELECT id, experiment, measurement_category AS c, sample_group AS g, contains(csv_path, '_post') AS post FROM baselines_metadata WHERE csv_path IS NOT NULL AND experiment IS NOT NULL AND measurement_category IS NOT NULL AND sample_group IS NOT NULL),
p AS (SELECT experiment, c, g, min(id) AS pre FROM x WHERE NOT post GROUP BY ALL), w AS (SELECT experiment, c, pre FROM p)
SELECT x.id, p.pre, 'strict' AS pairing FROM x JOIN p USING (experiment, c, g) WHERE post UNION ALL SELECT x.id, w.pre, 'wide' FROM x JOIN w USING (experiment, c) WHERE post AND (x.experiment, x.c, x.g) NOT IN (SELECT experiment, c, g FROM p)""")
def _(t):
    x = t("baselines_metadata").select("id", "experiment", F.col("measurement_category").alias("c"), F.col("sample_group").alias("g"), F.contains("csv_path", F.lit("_post")).alias("post")).dropna()
    pre = x.filter("NOT post").groupBy("experiment", "c", "g").agg(F.min("id").alias("pre"))
    return ranking.strict_or_wide(x.filter("post"), pre, ["experiment", "c", "g"], ["experiment", "c"]).select("id", "pre", "pairing")


RANKED = f"""WITH {laboratory.PAIRS}, k AS (SELECT target, candidate, 'balance' AS method, row_number() OVER (PARTITION BY target ORDER BY abs(x1 - y1), candidate) AS rank FROM pairs UNION ALL SELECT target, candidate, 'code', row_number() OVER (PARTITION BY target ORDER BY abs(x2 - y2) NULLS LAST, candidate) FROM pairs),
t AS (SELECT target, max(candidate) AS candidate FROM pairs GROUP BY 1)"""


@query("match_ranking_quality", RANKED + " SELECT method, count(*) AS targets, count(*) FILTER (WHERE rank = 1) AS top1, count(*) FILTER (WHERE rank <= 3) AS top3, round(avg(rank), 6) AS mean_rank FROM k JOIN t USING (target, candidate) GROUP BY 1")
def _(t):
    c, s = laboratory.pair_sides(t)
    k = ranking.last_ranks(c, s, ["k"], {"balance": ("x1", "y1"), "code": ("x2", "y2")}, "target", "candidate")
    q = ranking.ranking_quality(k, "method", "rank")
    return q.withColumn("mean_rank", r("mean_rank"))


@query("match_argmin", f"""
WITH {laboratory.PAIRS} SELECT target, candidate, round(score, 6) AS score FROM (SELECT target, candidate, CASE WHEN x2 IS DISTINCT FROM y2 THEN 10 ELSE 0 END + abs(x1 - y1) / greatest(abs(x1), 1) AS score, row_number() OVER (PARTITION BY target ORDER BY round(CASE WHEN x2 IS DISTINCT FROM y2 THEN 10 ELSE 0 END + abs(x1 - y1) / greatest(abs(x1), 1), 9), candidate) AS n FROM pairs) WHERE n = 1""")
def _(t):
    def score(x, y):
        ((x1, k1), (x2, k2)), ((y1, n1), (y2, n2)) = x, y
        unlike = np.where((k2 != n2) | (k2 & n2 & (x2 != y2)), 10.0, 0.0)
        return np.where(k1 & n1, unlike + np.abs(x1 - y1) / np.maximum(np.abs(x1), 1.0), np.nan)

    c, s = laboratory.pair_sides(t)
    return bounds.best_candidates(c, s, ["k"], [("x1", "y1"), ("x2", "y2")], "target", "candidate", [score], shown=6).drop("place")


def flagged(t):
    f = t("baselines_metadata")
    marks = cleaning.flags(no_points=F.coalesce("num_points", F.lit(0)) == 0, no_device=F.coalesce(F.trim("device_id"), F.lit("")) == "", no_hash=F.col("file_hash").isNull(), irradiated=F.col("is_likely_irradiated"), no_category=F.col("measurement_category").isNull())
    return f.select("id", marks.alias("flags"))


FLAGS = """WITH f AS (SELECT id, coalesce(num_points, 0) = 0 AS no_points, coalesce(trim(device_id), '') = '' AS no_device, file_hash IS NULL AS no_hash, coalesce(is_likely_irradiated, false) AS irradiated, measurement_category IS NULL AS no_category FROM baselines_metadata)"""


@query("match_flag_counts", FLAGS + """, u AS (SELECT 'no_points' AS flag, count(*) FILTER (WHERE no_points) AS n FROM f UNION ALL SELECT 'no_device', count(*) FILTER (WHERE no_device) FROM f UNION ALL SELECT 'no_hash', count(*) FILTER (WHERE no_hash) FROM f
  UNION ALL SELECT 'irradiated', count(*) FILTER (WHERE irradiated) FROM f UNION ALL SELECT 'no_category', count(*) FILTER (WHERE no_category) FROM f) SELECT flag, n FROM u WHERE n > 0""")
def _(t):
    return ranking.flag_counts(flagged(t), "flags")


@query("match_quality_status", FLAGS + " SELECT id, CASE WHEN no_points OR no_category THEN 'excluded' WHEN no_device OR no_hash THEN 'incomplete' ELSE 'usable' END AS status FROM f")
def _(t):
    ladder = [("excluded", ["no_points", "no_category"]), ("incomplete", ["no_device", "no_hash"])]
    return flagged(t).select("id", ranking.status(ladder, F.col("flags"), "usable").alias("status"))


@query("match_list_order", """
WITH l AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS p FROM orders GROUP BY 1), u AS (SELECT o_custkey, unnest(p) AS v, generate_subscripts(p, 1) AS k FROM l), f AS (SELECT o_custkey, v, min(k) AS k FROM u GROUP BY ALL)
SELECT o_custkey, string_agg(v, ' > ' ORDER BY k) AS priorities FROM f GROUP BY 1""")
def _(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return t("orders").groupBy("o_custkey").agg(F.array_join(F.array_distinct(ordered), " > ").alias("priorities"))


@query("donor_shifted_curves", laboratory.GATE + """,
sh AS (SELECT z.id AS metadata_id, s.med - z.v AS shift FROM z JOIN s ON z.experiment = s.experiment), pts AS (SELECT metadata_id, CASE WHEN abs(v_gate) < 1e30 THEN v_gate END AS g, CASE WHEN abs(i_drain) < 1e30 THEN i_drain END AS i FROM baselines_measurements)
SELECT metadata_id, count(*) AS points, round(avg(g + coalesce(shift, 0)), 5) AS v_gate, round(max(i * exp(-coalesce(shift / 10, 0))), 6) AS i_drain FROM pts LEFT JOIN sh USING (metadata_id) GROUP BY 1""")
def _(t):
    g = parameters.population_gate(laboratory.gated(t).filter("experiment IS NOT NULL"), "experiment", "vth_v")
    shift = F.col("median") - F.col("vth_v")
    s = g.select(F.col("id").alias("metadata_id"), shift.alias("shift"), (shift / 10).alias("log_ratio"))
    p = cleaning.cleaned(t("baselines_measurements").select("metadata_id", "v_gate", "i_drain"), ("v_gate", "i_drain"))
    c = ranking.shifted_curves(p, s, "metadata_id", "v_gate", "i_drain")
    return c.groupBy("metadata_id").agg(F.count("*").alias("points"), r(F.avg("v_gate"), 5).alias("v_gate"), r(F.max("i_drain")).alias("i_drain"))


@query("donor_forest")
def _(t):
    f = t("baselines_metadata").filter("experiment IS NOT NULL")
    return ranking.forest_residuals(f, ["sweep_start", "sweep_stop", "bias_value"], "num_points", "experiment")


@query("src_assigned_runs", r"""
WITH n AS (SELECT id, try_cast(nullif(regexp_extract(filename, '_([0-9]{3})[.]', 1), '') AS INTEGER) AS run, irrad_campaign_id AS c FROM baselines_metadata), k AS (SELECT run, min(id) AS first FROM n WHERE run > 0 GROUP BY 1)
SELECT n.id, n.run, CASE WHEN n.run IS NULL THEN 'unknown' WHEN n.run <= 3 THEN 'pre' ELSE 'run' END AS role, k.first FROM n LEFT JOIN k ON k.run = n.run""")
def _(t):
    n = t("baselines_metadata").select("id", F.regexp_extract("filename", "_([0-9]{3})[.]", 1).try_cast("int").alias("run"))
    k = n.filter("run > 0").groupBy("run").agg(F.min("id").alias("first"))
    role = F.when(F.col("run").isNull(), "unknown").when(F.col("run") <= 3, "pre").otherwise("run")
    return n.join(k, "run", "left").select("id", "run", role.alias("role"), "first")


@query("src_bulk_assign", """
SELECT id, CASE WHEN experiment LIKE '%ageing%' AND is_likely_irradiated AND irrad_campaign_id IS NULL THEN 99 ELSE irrad_campaign_id END AS irrad_campaign_id FROM baselines_metadata""")
def _(t):
    f = t("baselines_metadata").select("id", "experiment", "is_likely_irradiated", "irrad_campaign_id")
    wanted = f.filter("experiment LIKE '%ageing%' AND is_likely_irradiated AND irrad_campaign_id IS NULL").select("id", F.lit(99).alias("irrad_campaign_id"))
    return sinks.update_from(f, wanted, ["id"], ["irrad_campaign_id"]).select("id", "irrad_campaign_id")


@query("serve_value_counts", """
SELECT 'category' AS field, coalesce(measurement_category, 'none') AS value, count(*) AS n FROM baselines_metadata GROUP BY ALL UNION ALL SELECT 'source', coalesce(data_source, 'none'), count(*) FROM baselines_metadata GROUP BY ALL""")
def _(t):
    f = t("baselines_metadata")
    pair = F.inline(F.array(*(F.struct(F.lit(n).alias("field"), F.coalesce(c, F.lit("none")).alias("value")) for n, c in (("category", F.col("measurement_category")), ("source", F.col("data_source"))))))
    return f.select(pair).groupBy("field", "value").agg(F.count("*").alias("n"))


@query("serve_bound_fallback", """
WITH o AS (SELECT experiment, measurement_category AS c, bias_value AS v, is_likely_irradiated AS failed FROM baselines_metadata WHERE bias_value > 0 AND is_likely_irradiated IS NOT NULL AND experiment IS NOT NULL AND measurement_category IS NOT NULL),
n AS (SELECT experiment, c, count(*) FILTER (WHERE NOT failed) AS a, count(*) FILTER (WHERE failed) AS b, max(v) FILTER (WHERE NOT failed) AS s, min(v) FILTER (WHERE failed) AS d FROM o GROUP BY ALL),
w AS (SELECT c, count(*) FILTER (WHERE NOT failed) AS a, count(*) FILTER (WHERE failed) AS b, max(v) FILTER (WHERE NOT failed) AS s, min(v) FILTER (WHERE failed) AS d FROM o GROUP BY ALL)
SELECT n.experiment, n.c, CASE WHEN n.a >= 3 AND n.b >= 3 THEN least(n.s, n.d) WHEN w.a >= 3 AND w.b >= 3 THEN least(w.s, w.d) END AS low, CASE WHEN n.a >= 3 AND n.b >= 3 THEN greatest(n.s, n.d) WHEN w.a >= 3 AND w.b >= 3 THEN greatest(w.s, w.d) END AS high,
  CASE WHEN n.a >= 3 AND n.b >= 3 THEN 'own' WHEN w.a >= 3 AND w.b >= 3 THEN 'wider' ELSE 'none' END AS source FROM n JOIN w ON n.c = w.c""")
def _(t):
    f = t("baselines_metadata").filter("experiment IS NOT NULL AND measurement_category IS NOT NULL").withColumn("c", F.col("measurement_category")).withColumn("basis", F.lit("bias"))
    own = bounds.bracket(f, ["experiment", "c"], "basis", "bias_value", "is_likely_irradiated")
    wide = bounds.bracket(f, ["c"], "basis", "bias_value", "is_likely_irradiated")
    return bounds.with_fallback(own, wide, ["experiment", "c"], ["c"])


CONTEXTS = """WITH c AS (SELECT device_id, coalesce(data_source, 'baselines') AS source, coalesce(measurement_category, '?') AS category, max(plc) AS plc, max(drain_bias_value) AS bias, min(drain_bias_value) AS least_bias, max(sweep_stop) AS vds, min(sweep_stop) AS least_vds, ln(max(CASE WHEN num_points > 0 THEN num_points END)) AS duration, count(*) AS n
  FROM baselines_metadata WHERE trim(device_id) <> '' GROUP BY ALL),
p AS (SELECT t.device_id || '|' || t.category AS target_key, c.source AS candidate_source, c.source || '|' || c.category AS candidate_key, abs(t.plc - c.plc) AS x1, abs(t.bias - c.bias) / 100 AS x2, CASE WHEN c.source <> 'avalanche' THEN abs(t.vds - c.vds) / 1000 END AS x3, abs(t.duration - c.duration) AS dl, CASE WHEN t.category = c.category THEN 0.0 ELSE 0.15 END AS pen,
  CASE WHEN c.n >= 3 THEN 'usable' WHEN c.n = 2 THEN 'weak' END AS said, c.category = 'Blocking' AS ceiling, t.category = c.category AS same, t.vds AS tv, t.least_vds AS tl, c.vds AS cv, c.least_vds AS cl, t.bias AS tb, t.least_bias AS tlb, c.bias AS cb, c.least_bias AS clb, c.n AS n
  FROM c t JOIN c ON c.device_id = t.device_id AND t.source = 'irradiation' AND c.source <> 'irradiation'),
d AS (SELECT *, (x1 IS NOT NULL)::INT + (x2 IS NOT NULL)::INT + (x3 IS NOT NULL)::INT AS used, concat_ws('+', CASE WHEN x1 IS NOT NULL THEN 'collapse' END, CASE WHEN x2 IS NOT NULL THEN 'gate' END, CASE WHEN x3 IS NOT NULL THEN 'vds' END) AS mask,
  (coalesce(pow(x1 / 0.25, 2), 0) + coalesce(pow(x2 / 0.2, 2), 0) + coalesce(pow(x3 / 0.15, 2), 0)) / nullif((x1 IS NOT NULL)::INT + (x2 IS NOT NULL)::INT + (x3 IS NOT NULL)::INT, 0) AS m FROM p),
w AS (SELECT *, sqrt(m + 0.01 * pow(coalesce(dl, 1), 2)) AS wave FROM d),
s AS (SELECT *, CASE WHEN used = 0 THEN 'missing_damage_signature_overlap' WHEN sqrt(m) > 2.5 THEN 'damage_signature_mismatch' WHEN said = 'usable' AND wave <= 1.75 THEN 'measured_damage_candidate' WHEN said = 'weak' AND wave <= 3 THEN 'weak_measured_candidate' WHEN wave <= 1.25 THEN 'waveform_only_candidate' WHEN said IS NULL THEN 'missing_damage_context' ELSE 'inspect_manually' END AS raw FROM w),
k AS (SELECT *, CASE WHEN ceiling AND raw IN ('measured_damage_candidate', 'weak_measured_candidate', 'waveform_only_candidate') THEN 'analog_questionable' ELSE raw END AS status FROM s),
z AS (SELECT *, CASE status WHEN 'measured_damage_candidate' THEN 1 WHEN 'weak_measured_candidate' THEN 4 WHEN 'analog_questionable' THEN 5 WHEN 'waveform_only_candidate' THEN 5 WHEN 'missing_damage_context' THEN 5 ELSE 6 END AS priority FROM k)"""
CLASS = "CASE WHEN {a} IS NULL OR {b} IS NULL OR {c} IS NULL OR {d} IS NULL THEN 4 WHEN {a} <= {d} AND {c} <= {b} THEN CASE WHEN least({b} - {a}, {d} - {c}) <= 0 THEN 0 WHEN (least({b}, {d}) - greatest({a}, {c})) / least({b} - {a}, {d} - {c}) >= 0.5 THEN 0 ELSE 1 END WHEN least({b} - {a}, {d} - {c}) <= 0 THEN 3 WHEN greatest({a}, {c}) - least({b}, {d}) <= least({b} - {a}, {d} - {c}) THEN 2 ELSE 3 END"


def _candidate_pairs(t):
    """Contexts (device, source, category) of irradiated devices with those of the same device from other sources: a
    device has no more contexts than there are sources and categories, however many files it has."""
    f = t("baselines_metadata").filter("trim(device_id) <> ''")
    c = f.groupBy("device_id", F.coalesce("data_source", F.lit("baselines")).alias("source"), F.coalesce("measurement_category", F.lit("?")).alias("category")).agg(
        F.max("plc").alias("plc"), F.max("drain_bias_value").alias("bias"), F.min("drain_bias_value").alias("least_bias"), F.max("sweep_stop").alias("vds"), F.min("sweep_stop").alias("least_vds"),
        F.ln(F.max(F.when(F.col("num_points") > 0, F.col("num_points")))).alias("duration"), F.count("*").alias("n"),
    )
    target = c.filter("source = 'irradiation'").select("device_id", *(F.col(x).alias(f"t_{x}") for x in c.columns if x != "device_id"))
    p = target.join(c.filter("source <> 'irradiation'"), "device_id")
    far = lambda x: F.abs(F.col(f"t_{x}") - F.col(x))
    return p.withColumns({
        "target_key": F.concat("device_id", F.lit("|"), "t_category"), "candidate_source": F.col("source"), "candidate_key": F.concat("source", F.lit("|"), "category"), "match_scope": F.lit("same_device"),
        "collapse_delta": far("plc"), "gate_delta": far("bias") / 100, "normalized_vds_delta": F.when(F.col("source") != "avalanche", far("vds") / 1000), "duration_log_delta": far("duration"),
        "path_penalty": F.when(F.col("t_category") == F.col("category"), 0.0).otherwise(0.15), "damage_distance": F.lit(None).cast("double"),
        "damage_comparability_status": F.when(F.col("n") >= 3, "usable").when(F.col("n") == 2, "weak"), "mechanism_status_ceiling": F.when(F.col("category") == "Blocking", "analog_questionable"),
    })


@query("match_v1_rank", CONTEXTS + """,
m AS (SELECT *, row_number() OVER (PARTITION BY target_key, mask ORDER BY sqrt(m) NULLS LAST, dl NULLS LAST, candidate_source, candidate_key) AS mask_rank FROM z),
v AS (SELECT *, row_number() OVER (PARTITION BY target_key ORDER BY priority, mask_rank, used DESC, candidate_source, candidate_key) AS candidate_rank FROM m)
SELECT target_key, candidate_key, status, mask AS axis_mask, mask_rank, candidate_rank, round(sqrt(m), 6) AS axis_distance FROM v WHERE candidate_rank <= 10""")
def _(t):
    v = proxies.rank_by_signature(proxies.classified(_candidate_pairs(t)), top=10)
    return v.select("target_key", "candidate_key", "status", "axis_mask", "mask_rank", "candidate_rank", r("axis_distance").alias("axis_distance"))


@query("match_v2_rank", CONTEXTS + f""",
o AS (SELECT *, {CLASS.format(a="cl", b="cv", c="tl", d="tv")} AS o1, {CLASS.format(a="clb", b="cb", c="tlb", d="tb")} AS o2 FROM z WHERE tv IS NOT NULL AND cv IS NOT NULL),
v AS (SELECT *, row_number() OVER (PARTITION BY target_key ORDER BY priority, CASE WHEN same THEN 0 WHEN ceiling THEN 1 ELSE 2 END, o1, o2, CASE WHEN cv > 0 AND tv > 0 THEN abs(ln(cv / 1000) - ln(tv / 1000)) ELSE abs(dl) END NULLS LAST, CASE WHEN n >= 2 THEN 0 ELSE 1 END, candidate_key) AS energy_rank FROM o)
SELECT target_key, candidate_key, status, energy_rank FROM v WHERE energy_rank <= 10""")
def _(t):
    p = proxies.classified(_candidate_pairs(t)).withColumns({
        "fraction_overlap": intervals.overlap("least_vds", "vds", "t_least_vds", "t_vds"), "energy_overlap": intervals.overlap("least_bias", "bias", "t_least_bias", "t_bias"),
        "failure_fraction": F.col("vds") / 1000, "severity_ratio": F.col("t_vds") / 1000, "log_energy_delta": F.col("duration_log_delta"), "energy_rankable": F.col("vds").isNotNull() & F.col("t_vds").isNotNull(),
        "regime_match": F.when(F.col("t_category") == F.col("category"), "match").when(F.col("category") == "Blocking", "analog_questionable").otherwise("mechanism_mismatch"),
        "exposure": F.when(F.col("n") >= 2, "cumulative_present").otherwise("not_applicable"),
    })
    return proxies.rank_by_energy(p, top=10).select("target_key", "candidate_key", "status", "energy_rank")


QUERIES, SQL = query.queries, query.sql
