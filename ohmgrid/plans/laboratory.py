"""Queries over the measurement database: parameters, events, doses, donors, bounds, charts, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ohmgrid.functions import intervals, parsing, physics
from ohmgrid.operators import bounds, cleaning, dose, donors, events, parameters, series, statistics
from ohmgrid.plans.base import Registry
from ohmgrid.session import join_dimension
from ohmgrid.sources import binary_files, listing, sinks, text_files
from ohmgrid.streaming import events as stream

query = Registry()


def r(c, digits: int = 6):
    return F.round(c, digits)


# ---- parameters

BINNED = """WITH c AS (SELECT metadata_id, CASE WHEN abs(v_gate) < 1e30 THEN v_gate END AS g, CASE WHEN abs(v_drain) < 1e30 THEN v_drain END AS d, CASE WHEN abs(i_drain) < 1e30 THEN i_drain END AS i FROM baselines_measurements),
m AS (SELECT metadata_id, max(abs(i)) AS most FROM c GROUP BY 1),
b AS (SELECT c.metadata_id, f.measurement_category AS cat, CAST(round(CAST(g AS DECIMAL(28,9)), 2) AS DOUBLE) AS vg,
  CASE WHEN f.measurement_category IN ('IdVg', 'Vth') AND f.drain_bias_value IS NOT NULL THEN CAST(round(CAST(f.drain_bias_value AS DECIMAL(28,9)), 2) AS DOUBLE) ELSE CAST(round(CAST(d AS DECIMAL(28,9)), 2) AS DOUBLE) END AS vd, avg(i) AS i, avg(abs(i)) AS ai
  FROM c JOIN baselines_metadata f ON f.id = c.metadata_id JOIN m ON m.metadata_id = c.metadata_id WHERE i IS NULL OR most IS NULL OR abs(i) < 0.99 * most GROUP BY ALL)"""


def binned(t):
    return parameters.binned(t("baselines_measurements"), t("baselines_metadata"))


@query("param_vth", BINNED + """,
p AS (SELECT metadata_id, greatest(0.005, max(i) * 0.01) AS least FROM b WHERE cat IN ('Vth', 'IdVg') AND i > 0 GROUP BY 1),
x AS (SELECT b.metadata_id, vd, min(vg) AS v FROM b JOIN p USING (metadata_id) WHERE cat IN ('Vth', 'IdVg') AND i > 0 AND i >= least AND vd IS NOT NULL GROUP BY ALL)
SELECT metadata_id, v AS vth_v, vd AS vth_vds FROM (SELECT *, row_number() OVER (PARTITION BY metadata_id ORDER BY abs(vd), vd, v) AS n FROM x) WHERE n = 1""")
def _(t):
    return parameters.vth(binned(t))


@query("param_rdson", BINNED + """,
k AS (SELECT metadata_id, max(vg) AS top_vg, max(vd) AS top_vd FROM b WHERE cat = 'IdVd' AND i > 0 GROUP BY 1)
SELECT b.metadata_id, round(sum(vd * vd) / nullif(sum(vd * i), 0) * 1000, 4) AS rdson_mohm FROM b JOIN k USING (metadata_id) WHERE cat = 'IdVd' AND i > 0 AND vg >= top_vg - 1 AND vd > 0 AND vd <= least(top_vd * 0.15, 2.0) GROUP BY 1""")
def _(t):
    return parameters.rdson(binned(t)).select("metadata_id", r("rdson_mohm", 4).alias("rdson_mohm"))


@query("param_bvdss", BINNED + """,
o AS (SELECT * FROM b WHERE cat = 'Blocking' AND vg BETWEEN -1 AND 1), x AS (SELECT metadata_id, min(vd) AS bvdss_v, true AS crossed FROM o WHERE ai >= 100e-6 GROUP BY 1)
SELECT * FROM x UNION ALL SELECT metadata_id, max(vd), false FROM o WHERE metadata_id NOT IN (SELECT metadata_id FROM x) GROUP BY 1""")
def _(t):
    return parameters.bvdss(binned(t))


@query("param_reverse_drop", BINNED + """,
o AS (SELECT * FROM b WHERE cat = 'Blocking' AND i < 0), a AS (SELECT metadata_id, max(vg) AS anchor FROM o GROUP BY 1), s AS (SELECT o.* FROM o JOIN a USING (metadata_id) WHERE abs(vg - anchor) <= 0.5),
g AS (SELECT metadata_id, min(i) * 0.1 AS target FROM s GROUP BY 1 HAVING abs(min(i)) >= 1e-9)
SELECT metadata_id, v AS vsd_v FROM (SELECT s.metadata_id, abs(vd) AS v, row_number() OVER (PARTITION BY s.metadata_id ORDER BY abs(i - target), abs(vd)) AS n FROM s JOIN g USING (metadata_id)) WHERE n = 1""")
def _(t):
    return parameters.vsd(binned(t), category="Blocking", least=1e-9)


GATE = BINNED + """,
p AS (SELECT metadata_id, greatest(0.005, max(i) * 0.01) AS least FROM b WHERE cat IN ('Vth', 'IdVg') AND i > 0 GROUP BY 1),
x AS (SELECT b.metadata_id, vd, min(vg) AS v FROM b JOIN p USING (metadata_id) WHERE cat IN ('Vth', 'IdVg') AND i > 0 AND i >= least AND vd IS NOT NULL GROUP BY ALL),
y AS (SELECT metadata_id, v FROM (SELECT *, row_number() OVER (PARTITION BY metadata_id ORDER BY abs(vd), vd, v) AS n FROM x) WHERE n = 1),
z AS (SELECT f.id, f.experiment, f.device_id, y.v FROM baselines_metadata f JOIN y ON y.metadata_id = f.id),
s AS (SELECT experiment, count(*) AS n, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM z GROUP BY 1)"""


def gated(t):
    v = parameters.vth(binned(t)).select(F.col("metadata_id").alias("id"), "vth_v")
    return t("baselines_metadata").select("id", "experiment", "device_id").join(v, "id")


@query("param_gate", GATE + """
SELECT id, CASE WHEN s.n < 3 THEN 'too few' WHEN abs(v - med) <= 3 * iqr THEN 'inside' ELSE 'outside' END AS decision FROM z JOIN s ON z.experiment = s.experiment""")
def _(t):
    return parameters.population_gate(gated(t).filter("experiment IS NOT NULL"), "experiment", "vth_v").select("id", "decision")


@query("param_flagged_devices", GATE + """
SELECT id, coalesce(bool_or(v < 0 OR v < med - 3 * iqr) OVER (PARTITION BY z.experiment, device_id), false) AS flagged FROM z JOIN s ON z.experiment = s.experiment""")
def _(t):
    return parameters.flag_devices(gated(t).filter("experiment IS NOT NULL"), "experiment", "device_id", "vth_v").select("id", "flagged")


@query("param_sweep_extent", """
WITH c AS (SELECT metadata_id, CASE WHEN abs(v_gate) < 1e30 THEN v_gate END AS g, CASE WHEN abs(v_drain) < 1e30 THEN v_drain END AS d, CASE WHEN abs(i_drain) < 1e30 THEN i_drain END AS i FROM baselines_measurements)
SELECT metadata_id, min(d) AS min_v_drain, max(d) AS max_v_drain, min(i) AS min_i_drain, max(i) AS max_i_drain, min(g) AS min_v_gate, max(g) AS max_v_gate, count(*) AS points FROM c GROUP BY 1""")
def _(t):
    return parameters.sweep_extent(t("baselines_measurements"))


@query("param_refined_category", """
WITH c AS (SELECT metadata_id, min(d) AS lo, max(d) AS hi, max(abs(i)) AS most, min(i) AS least_i FROM (SELECT metadata_id, CASE WHEN abs(v_drain) < 1e30 THEN v_drain END AS d, CASE WHEN abs(i_drain) < 1e30 THEN i_drain END AS i FROM baselines_measurements) GROUP BY 1)
SELECT metadata_id, measurement_category, CASE WHEN measurement_category IS DISTINCT FROM 'IdVd' THEN measurement_category WHEN hi >= 30 AND coalesce(most, 0) < 1 THEN 'Blocking' WHEN hi <= 0.5 AND lo < -0.1 AND least_i < -1e-7 THEN '3rd_Quadrant' ELSE measurement_category END AS refined
FROM c JOIN baselines_metadata f ON f.id = c.metadata_id""")
def _(t):
    return parameters.refined_category(parameters.sweep_extent(t("baselines_measurements")), t("baselines_metadata"))


# ---- events, energies, doses

POS = """WITH q AS (SELECT DISTINCT metadata_id, point_index, CASE WHEN true THEN time_val END AS time_val, CASE WHEN abs(v_gate) < 1e30 THEN v_gate END AS v_gate, CASE WHEN abs(i_gate) < 1e30 THEN i_gate END AS i_gate, CASE WHEN abs(v_drain) < 1e30 THEN v_drain END AS v_drain, CASE WHEN abs(i_drain) < 1e30 THEN i_drain END AS i_drain, fluence
  FROM baselines_measurements WHERE abs(time_val) < 1e30), pos AS (SELECT *, row_number() OVER (PARTITION BY metadata_id ORDER BY time_val, point_index) AS position FROM q)"""


def positioned(t):
    return events.positioned(t("baselines_measurements").filter("abs(time_val) < 1e30"))


CANDIDATES = POS + """, d AS (SELECT metadata_id, position, abs(i_drain) - lag(abs(i_drain)) OVER w AS dd, abs(i_gate) - lag(abs(i_gate)) OVER w AS dg FROM pos WINDOW w AS (PARTITION BY metadata_id ORDER BY position)),
md AS (SELECT *, quantile_cont(dd, 0.5) OVER (PARTITION BY metadata_id) AS m1, quantile_cont(dg, 0.5) OVER (PARTITION BY metadata_id) AS m2 FROM d),
s AS (SELECT metadata_id, CASE WHEN count(dd) < 5 THEN 0 WHEN quantile_cont(abs(dd - m1), 0.5) > 0 THEN 1.4826 * quantile_cont(abs(dd - m1), 0.5) ELSE stddev_pop(dd) END AS s1, CASE WHEN count(dg) < 5 THEN 0 WHEN quantile_cont(abs(dg - m2), 0.5) > 0 THEN 1.4826 * quantile_cont(abs(dg - m2), 0.5) ELSE stddev_pop(dg) END AS s2 FROM md GROUP BY 1),
rm AS (SELECT metadata_id, position, quantile_cont(abs(i_drain), 0.5) OVER n - quantile_cont(abs(i_drain), 0.5) OVER b AS rd, quantile_cont(abs(i_gate), 0.5) OVER n - quantile_cont(abs(i_gate), 0.5) OVER b AS rg FROM pos
  WINDOW b AS (PARTITION BY metadata_id ORDER BY position ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), n AS (PARTITION BY metadata_id ORDER BY position ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
k AS (SELECT d.metadata_id, position, greatest(coalesce(dd, 0), coalesce(rd, 0), 0) AS d_drain, greatest(coalesce(dg, 0), coalesce(rg, 0), 0) AS d_gate, greatest(1e-6, 8 * s1) AS t_drain, greatest(1e-8, 8 * s2) AS t_gate FROM d JOIN s USING (metadata_id) JOIN rm USING (metadata_id, position)),
cand AS (SELECT * FROM k WHERE d_drain >= t_drain OR (d_gate >= t_gate AND d_drain >= 0.25 * t_drain)),
isl AS (SELECT *, sum(CASE WHEN position - prev <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY metadata_id ORDER BY position) AS event FROM (SELECT *, lag(position) OVER (PARTITION BY metadata_id ORDER BY position) AS prev FROM cand))"""


@query("event_clusters", CANDIDATES + """
SELECT metadata_id, CAST(event AS BIGINT) AS event, min(position) AS first, max(position) AS last, count(*) AS steps, round(max(d_drain) * 1e9, 3) AS rise_na FROM isl GROUP BY ALL""")
def _(t):
    c = series.islands(events.candidates(positioned(t)), ["metadata_id"], "position", events.Detector.gap)
    return c.groupBy("metadata_id", F.col("island").alias("event")).agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count("*").alias("steps"), r(F.max("d_drain") * 1e9, 3).alias("rise_na"))


@query("event_classes", CANDIDATES + """,
e AS (SELECT metadata_id, event, max(d_drain) AS rd, max(d_gate) AS rg, max(t_drain) AS td, max(t_gate) AS tg FROM isl GROUP BY ALL)
SELECT metadata_id, CASE WHEN rd >= td AND rg < tg THEN 'drain_source' WHEN rg >= tg AND rd / nullif(rg, 0) BETWEEN 0.33 AND 3.0 THEN 'drain_gate' WHEN rg >= tg AND rd / nullif(rg, 0) >= 10 THEN 'drain_source' ELSE 'mixed' END AS kind, count(*) AS events FROM e GROUP BY ALL""")
def _(t):
    return events.events(positioned(t)).groupBy("metadata_id", "kind").agg(F.count("*").alias("events"))


@query("event_context", CANDIDATES + """,
e AS (SELECT metadata_id, event, min(position) AS lo, max(position) AS hi FROM isl GROUP BY ALL)
SELECT e.metadata_id, CAST(e.event AS BIGINT) AS event, round(quantile_cont(v_drain, 0.5) FILTER (WHERE position < lo), 4) AS v_before, round(quantile_cont(v_drain, 0.5) FILTER (WHERE position > hi), 4) AS v_after,
  round(greatest(quantile_cont(v_drain, 0.5) FILTER (WHERE position < lo) - quantile_cont(v_drain, 0.5) FILTER (WHERE position > hi), 0) / nullif(abs(quantile_cont(v_drain, 0.5) FILTER (WHERE position < lo)), 0), 5) AS collapse
FROM e JOIN pos ON pos.metadata_id = e.metadata_id AND position BETWEEN lo - 4 AND hi + 4 GROUP BY e.metadata_id, e.event""")
def _(t):
    e = events.collapse(events.events(positioned(t)))
    return e.select("metadata_id", "event", r("v_before", 4).alias("v_before"), r("v_after", 4).alias("v_after"), r("collapse", 5).alias("collapse"))


ACTIVE = POS + """, fl AS (SELECT metadata_id, time_val, fluence, lag(time_val) OVER w AS t0, fluence - lag(fluence) OVER w AS df FROM pos WHERE fluence IS NOT NULL AND NOT isnan(fluence) AND time_val IS NOT NULL WINDOW w AS (PARTITION BY metadata_id ORDER BY position)),
tol AS (SELECT metadata_id, greatest(1e-9, 1e-9 * max(abs(fluence))) AS tol FROM fl GROUP BY 1),
bm AS (SELECT metadata_id, min(t0) FILTER (WHERE df > tol) AS a0, max(time_val) FILTER (WHERE df > tol) AS a1, count(*) FILTER (WHERE df < -tol) AS falls, max(fluence) - min(fluence) AS span, count(*) AS n FROM fl JOIN tol USING (metadata_id) GROUP BY 1),
fi AS (SELECT metadata_id, count(time_val) AS times FROM pos GROUP BY 1),
bs AS (SELECT fi.metadata_id, a0, a1, CASE WHEN times = 0 THEN 'unknown_no_time' WHEN coalesce(n, 0) < 2 THEN 'unknown_no_fluence' WHEN falls > 0 THEN 'fluence_reset_artifact' WHEN a0 IS NOT NULL AND span >= 1 THEN 'fluence_positive_delta' ELSE 'fluence_static_or_missing_progression' END AS basis,
  least(CASE WHEN abs(f.compliance_ch1) > 0 THEN abs(f.compliance_ch1) END, CASE WHEN abs(f.compliance_ch2) > 0 THEN abs(f.compliance_ch2) END) AS comp FROM fi LEFT JOIN bm USING (metadata_id) LEFT JOIN baselines_metadata f ON f.id = fi.metadata_id),
ht AS (SELECT p.metadata_id, min(p.time_val) AS hit FROM pos p JOIN bs ON bs.metadata_id = p.metadata_id AND basis = 'fluence_positive_delta' AND p.time_val BETWEEN a0 AND a1 AND abs(p.i_drain) >= coalesce(0.995 * comp, 0.01) GROUP BY 1),
win AS (SELECT metadata_id, basis, CASE WHEN basis IN ('fluence_positive_delta', 'fluence_reset_artifact') THEN a0 END AS active_start, CASE WHEN basis IN ('fluence_positive_delta', 'fluence_reset_artifact') THEN a1 END AS active_stop,
  CASE basis WHEN 'fluence_positive_delta' THEN a0 END AS start, CASE basis WHEN 'fluence_positive_delta' THEN coalesce(hit, a1) END AS stop, hit AS failure,
  CASE WHEN hit IS NOT NULL AND comp IS NOT NULL THEN 'current_compliance' WHEN hit IS NOT NULL THEN 'heuristic_current_plateau' WHEN basis = 'fluence_positive_delta' THEN 'none' WHEN basis = 'fluence_reset_artifact' THEN basis ELSE 'active_window_unknown' END AS reason,
  basis = 'fluence_positive_delta' AND hit IS NULL AS comparable FROM bs LEFT JOIN ht USING (metadata_id))"""


@query("event_windows", ACTIVE + " SELECT * FROM win")
def _(t):
    return events.active_window(positioned(t), t("baselines_metadata"))


@query("event_point_flags", ACTIVE + """, g AS (SELECT metadata_id, coalesce(time_val BETWEEN active_start AND active_stop, false) AS active, coalesce(time_val <= failure, true) AS pre, coalesce(time_val BETWEEN start AND stop, false) AS inside, active_start, start FROM pos JOIN win USING (metadata_id))
SELECT metadata_id, CASE WHEN active_start IS NULL THEN 'active_window_unknown' WHEN NOT active THEN 'outside_active_window' WHEN NOT pre THEN 'post_failure_or_compliance' WHEN start IS NULL THEN 'energy_window_unknown' END AS exclusion, count(*) AS points, count(*) FILTER (WHERE inside AND pre) AS integrable FROM g GROUP BY ALL""")
def _(t):
    p = positioned(t)
    g = events.point_flags(p, events.active_window(p, t("baselines_metadata")))
    return g.groupBy("metadata_id", "exclusion").agg(F.count("*").alias("points"), F.count_if("integrable").alias("integrable"))


@query("event_energy", ACTIVE + """, x AS (SELECT p.metadata_id, position, time_val, v_drain * i_drain AS p FROM pos p JOIN win w ON w.metadata_id = p.metadata_id AND time_val BETWEEN start AND stop WHERE v_drain IS NOT NULL AND i_drain IS NOT NULL),
y AS (SELECT metadata_id, (greatest(p, 0) + lag(greatest(p, 0)) OVER w) / 2 * greatest(time_val - lag(time_val) OVER w, 0) AS e FROM x WINDOW w AS (PARTITION BY metadata_id ORDER BY position))
SELECT metadata_id, round(sum(e) * 1e6, 3) AS energy_uj, count(e) AS steps FROM y GROUP BY 1""")
def _(t):
    p = positioned(t)
    e = events.energy_in_windows(p, events.active_window(p, t("baselines_metadata")))
    return e.select("metadata_id", r(F.col("energy_j") * 1e6, 3).alias("energy_uj"), "steps")


@query("event_rates", CANDIDATES + """,
e AS (SELECT metadata_id, count(DISTINCT event) AS n FROM isl GROUP BY 1), sp AS (SELECT metadata_id, max(time_val) - min(time_val) AS sec, max(fluence) - min(fluence) AS fl FROM pos GROUP BY 1)
SELECT sp.metadata_id, coalesce(n, 0) AS events, round(coalesce(n, 0) / nullif(sec, 0), 9) AS per_second FROM sp LEFT JOIN e USING (metadata_id)""")
def _(t):
    p = positioned(t)
    return events.rates(events.events(p), events.spans(p)).select("metadata_id", "events", r("per_second", 9).alias("per_second"))


@query("event_pulse_history", """
WITH p AS (SELECT id, device_id, coalesce(try_cast(nullif(regexp_extract(filename, '_([0-9]+)[^_]*$', 1), '') AS INTEGER), 0) AS shot, CASE WHEN num_points = 0 THEN NULL ELSE CAST(num_points AS DOUBLE) END AS energy FROM baselines_metadata WHERE device_id IS NOT NULL)
SELECT id, row_number() OVER w AS pulse, CASE WHEN bool_or(energy IS NULL) OVER w THEN NULL ELSE sum(energy) OVER w END AS cumulative FROM p WINDOW w AS (PARTITION BY device_id ORDER BY shot, id)""")
def _(t):
    shot = F.coalesce(F.regexp_extract("filename", "_([0-9]+)[^_]*$", 1).try_cast("int"), F.lit(0))
    p = t("baselines_metadata").filter("device_id IS NOT NULL").select("id", "device_id", shot.alias("shot"), F.when(F.col("num_points") == 0, None).otherwise(F.col("num_points").cast("double")).alias("energy"))
    return events.pulse_history(p, ["device_id"], ["shot", "id"], "energy").select("id", "pulse", "cumulative")


#: Layers of a device and the stopping power of protons in silicon carbide, few points.
LAYERS = [(1, 10.0, 3.21, 0.02), (2, 350.0, 3.21, 0.02)]
STOPPING = [(0.1, 0.52), (1.0, 0.163), (3.0, 0.079), (10.0, 0.0322), (30.0, 0.0137), (100.0, 0.0054), (200.0, 0.0034)]


@query("event_layer_dose")
def _(t):
    f = t("baselines_measurements")
    spark = f.sparkSession
    layers = spark.createDataFrame(LAYERS, "layer_order int, thickness_um double, density double, area_cm2 double")
    stopping = spark.createDataFrame(STOPPING, "energy double, total double")
    files = t("baselines_metadata").select(F.col("id").alias("metadata_id"), "bias_value")
    c = f.groupBy("metadata_id").agg(F.max("fluence").alias("fluence")).filter("fluence IS NOT NULL").join(files, "metadata_id")
    c = c.select(F.col("metadata_id").alias("context_id"), F.greatest(F.lit(1.0), F.col("bias_value") / 10).alias("energy_mev"), "fluence")
    return dose.total_dose(dose.through_layers(c, layers, stopping))


# ---- similarity and prediction

FEATURES = """WITH x AS (SELECT id, experiment, measurement_category, sweep_stop, bias_value, plc, CAST(num_points AS DOUBLE) AS y FROM baselines_metadata WHERE experiment IS NOT NULL AND measurement_category IS NOT NULL),
j AS (SELECT a.id, b.id AS o, b.y, (a.sweep_stop - b.sweep_stop) / 100 AS d1, (a.bias_value - b.bias_value) / 50 AS d2, (a.plc - b.plc) / 5 AS d3 FROM x a JOIN x b ON a.experiment = b.experiment AND a.measurement_category = b.measurement_category AND a.id <> b.id WHERE b.y IS NOT NULL),
k AS (SELECT *, sqrt((coalesce(d1*d1, 0) + coalesce(d2*d2, 0) + coalesce(d3*d3, 0)) / (CAST(d1 IS NOT NULL AS INT) + CAST(d2 IS NOT NULL AS INT) + CAST(d3 IS NOT NULL AS INT))) AS dist FROM j WHERE d1 IS NOT NULL OR d2 IS NOT NULL OR d3 IS NOT NULL),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, o) AS k FROM k) WHERE k <= 7), w AS (SELECT *, 1 / greatest(dist, 0.05) AS w FROM n),
c AS (SELECT *, sum(w) OVER (PARTITION BY id ORDER BY y) AS run, sum(w) OVER (PARTITION BY id) AS total FROM w),
pred AS (SELECT id, min(y) FILTER (WHERE run >= 0.5 * total) AS p50, count(*) AS donors FROM c GROUP BY 1 HAVING count(*) >= 3)"""


def predicted(t):
    x = t("baselines_metadata").filter("experiment IS NOT NULL AND measurement_category IS NOT NULL").select("id", "experiment", "measurement_category", "sweep_stop", "bias_value", "plc", F.col("num_points").cast("double").alias("y"))
    f = ["sweep_stop", "bias_value", "plc"]
    return x, donors.predictions(x, x, ["experiment", "measurement_category"], f, {"sweep_stop": 100.0, "bias_value": 50.0, "plc": 5.0}, "id", "y")


@query("donor_predictions", FEATURES + " SELECT id, p50, donors FROM pred")
def _(t):
    return predicted(t)[1].select("id", "p50", "donors")


@query("donor_gates", FEATURES + """
SELECT measurement_category, count(*) AS pairs, round(quantile_cont(abs(p50 - y), 0.5), 5) AS median, round(quantile_cont(abs(p50 - y), 0.9), 5) AS p90, count(*) >= 10 AND quantile_cont(abs(p50 - y), 0.5) <= 10 AND quantile_cont(abs(p50 - y), 0.9) <= 60 AS passes FROM pred JOIN x USING (id) GROUP BY 1""")
def _(t):
    x, p = predicted(t)
    g = donors.residual_gate(p, x, "id", "y", ["measurement_category"], 10.0, 60.0)
    return g.select("measurement_category", "pairs", r("median", 5).alias("median"), r("p90", 5).alias("p90"), "passes")


@query("match_fingerprints", """
WITH f AS (SELECT experiment, CASE WHEN contains(csv_path, '_post') THEN 'post' ELSE 'pre' END AS phase, quantile_cont(sweep_stop, 0.5) AS a, count(sweep_stop) AS a_n, quantile_cont(sweep_stop, 0.75) - quantile_cont(sweep_stop, 0.25) AS a_iqr, quantile_cont(plc, 0.5) AS b, count(plc) AS b_n, quantile_cont(plc, 0.75) - quantile_cont(plc, 0.25) AS b_iqr FROM baselines_metadata WHERE experiment IS NOT NULL AND csv_path IS NOT NULL GROUP BY ALL),
j AS (SELECT l.experiment, l.a IS NOT NULL AND r.a IS NOT NULL AS ha, l.b IS NOT NULL AND r.b IS NOT NULL AS hb, sqrt(sqrt(greatest(l.a_n, 1)) / (1 + abs(coalesce(l.a_iqr, 0))) * sqrt(greatest(r.a_n, 1)) / (1 + abs(coalesce(r.a_iqr, 0)))) AS wa, sqrt(sqrt(greatest(l.b_n, 1)) / (1 + abs(coalesce(l.b_iqr, 0))) * sqrt(greatest(r.b_n, 1)) / (1 + abs(coalesce(r.b_iqr, 0)))) AS wb, r.a - l.a AS da, r.b - l.b AS db
  FROM f l JOIN f r ON l.experiment = r.experiment AND l.phase = 'pre' AND r.phase = 'post')
SELECT experiment, CAST(ha AS INT) + CAST(hb AS INT) AS axes, round(sqrt((CASE WHEN ha THEN wa * pow(da / 100, 2) ELSE 0 END + CASE WHEN hb THEN wb * pow(db / 5, 2) ELSE 0 END) / nullif(CASE WHEN ha THEN wa ELSE 0 END + CASE WHEN hb THEN wb ELSE 0 END, 0)), 6) AS distance FROM j""")
def _(t):
    phase = F.when(F.contains("csv_path", F.lit("_post")), "post").otherwise("pre")
    q = lambda c, p: F.percentile(c, F.lit(p))
    cols = [x for a, c in (("a", "sweep_stop"), ("b", "plc")) for x in (q(c, 0.5).alias(a), F.count(c).alias(f"{a}_n"), (q(c, 0.75) - q(c, 0.25)).alias(f"{a}_iqr"))]
    f = t("baselines_metadata").filter("experiment IS NOT NULL AND csv_path IS NOT NULL").groupBy("experiment", phase.alias("phase")).agg(*cols)
    left = f.filter("phase = 'pre'").withColumn("a_scale", F.lit(100.0)).withColumn("b_scale", F.lit(5.0)).withColumnRenamed("phase", "left_phase")
    d = donors.fingerprint_distance(left, f.filter("phase = 'post'").withColumnRenamed("phase", "right_phase"), ["experiment"], ["a", "b"], "experiment", "right_phase")
    return d.select("experiment", "axes", r("distance").alias("distance"))


@query("match_bracket", """
WITH o AS (SELECT experiment, measurement_category AS basis, bias_value AS v, is_likely_irradiated AS failed FROM baselines_metadata WHERE bias_value > 0 AND is_likely_irradiated IS NOT NULL AND experiment IS NOT NULL),
p AS (SELECT experiment, basis FROM (SELECT experiment, basis, row_number() OVER (PARTITION BY experiment ORDER BY count(*) DESC, basis) AS k FROM o WHERE basis IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
a AS (SELECT o.experiment, o.basis, count(*) FILTER (WHERE NOT failed) AS survived, count(*) FILTER (WHERE failed) AS destroyed, max(v) FILTER (WHERE NOT failed) AS s, min(v) FILTER (WHERE failed) AS d FROM o JOIN p ON o.experiment = p.experiment AND o.basis = p.basis GROUP BY ALL)
SELECT experiment, basis, survived, destroyed, CASE WHEN s IS NOT NULL AND d IS NOT NULL THEN least(s, d) END AS low, CASE WHEN s IS NOT NULL AND d IS NOT NULL THEN greatest(s, d) END AS high, s > d AS inverted, s IS NOT NULL AND d IS NOT NULL AND survived >= 3 AND destroyed >= 3 AS usable FROM a""")
def _(t):
    f = t("baselines_metadata").filter("experiment IS NOT NULL").withColumnRenamed("measurement_category", "basis")
    return bounds.bracket(f, ["experiment"], "basis", "bias_value", "is_likely_irradiated")


PAIRS = """pairs AS (SELECT c_custkey AS target, s_suppkey AS candidate, c_acctbal AS x1, s_acctbal AS y1, CAST(c_custkey % 7 AS DOUBLE) AS x2, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey % 7 AS DOUBLE) END AS y2 FROM customer JOIN supplier ON c_nationkey = s_nationkey)"""


def pair_sides(t):
    """Targets and candidates of the pairs, with their key k."""
    s = t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("candidate"), F.col("s_acctbal").alias("y1"), F.when(F.col("s_suppkey") % 5 == 0, None).otherwise((F.col("s_suppkey") % 7).cast("double")).alias("y2"))
    c = t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("target"), F.col("c_acctbal").alias("x1"), (F.col("c_custkey") % 7).cast("double").alias("x2"))
    return c, s


#: Targets in a task that pairs them.
TARGETS = 2_500


def pair_rows(t):
    """All pairs: as many for a target as its key has candidates, so the targets are dealt to tasks evenly, not by key."""
    c, s = pair_sides(t)
    return join_dimension(c.repartition(max(1, -(-c.count() // TARGETS)), "target"), s, "k")


@query("match_axis_distance", f"""
WITH {PAIRS} SELECT target, candidate, 1 + CAST(y2 IS NOT NULL AS INT) AS axes_used, round(sqrt((pow((x1 - y1) / 1000, 2) + coalesce(pow((x2 - y2) / 2, 2), 0)) / (1 + CAST(y2 IS NOT NULL AS INT))), 6) AS distance FROM pairs""")
def _(t):
    d = bounds.axis_distance(pair_rows(t), {"a": ("x1", "y1"), "b": ("x2", "y2")}, {"a": 1000.0, "b": 2.0})
    return d.select("target", "candidate", "axes_used", bounds.rounded("distance", 6).alias("distance"))


@query("match_grid", f"""
WITH {PAIRS}, g AS (SELECT * FROM (VALUES (1, 1000.0, 2.0), (2, 500.0, 4.0), (3, 4000.0, 1.0)) v(setting, a, b)),
d AS (SELECT setting, target, candidate, sqrt((pow((x1 - y1) / a, 2) + coalesce(pow((x2 - y2) / b, 2), 0)) / (1 + CAST(y2 IS NOT NULL AS INT))) AS distance FROM pairs, g)
SELECT setting, target, candidate, round(distance, 2) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY setting, target ORDER BY round(distance, 9), candidate) AS n FROM d) WHERE n = 1""")
def _(t):
    c, s = pair_sides(t)
    g = c.sparkSession.createDataFrame([(1, 1000.0, 2.0), (2, 500.0, 4.0), (3, 4000.0, 1.0)], "setting int, scale_a double, scale_b double")
    return bounds.grid_best(c, s, ["k"], g, {"a": ("x1", "y1"), "b": ("x2", "y2")}, "target", "candidate", shown=2)


@query("match_agreement", """
WITH p AS (SELECT c_mktsegment AS t, 'rich' AS m, first(c_custkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 'last', max(c_custkey) FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 'top', first(c_custkey ORDER BY c_acctbal DESC, c_custkey) FROM customer GROUP BY 1)
SELECT a.m AS method_a, b.m AS method_b, count(*) AS targets, count(*) FILTER (WHERE a.k IS NOT DISTINCT FROM b.k) AS agree FROM p a JOIN p b ON a.t = b.t AND a.m < b.m GROUP BY ALL""")
def _(t):
    g = t("customer").groupBy(F.col("c_mktsegment").alias("t"))
    rich = F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey")))
    picks = [g.agg(k.alias("k")).withColumn("m", F.lit(m)) for m, k in (("rich", rich), ("last", F.max("c_custkey")), ("top", rich))]
    return bounds.agreement(picks[0].unionByName(picks[1]).unionByName(picks[2]), "t", "m", "k")


@query("match_ecdf", """
SELECT measurement_category, plc, round(sum(n) OVER (PARTITION BY measurement_category ORDER BY plc) / sum(n) OVER (PARTITION BY measurement_category), 9) AS share FROM (SELECT measurement_category, plc, count(*) AS n FROM baselines_metadata WHERE plc IS NOT NULL GROUP BY ALL)""")
def _(t):
    return bounds.cumulative_shares(t("baselines_metadata"), ["measurement_category"], "plc").select("measurement_category", "plc", r("share", 9).alias("share"))


@query("src_reconcile", """
SELECT c.id, f.field, CASE WHEN c.id % 6 = 0 THEN 'insert' WHEN f.field = 'facility' AND c.id % 2 = 0 THEN 'fill_blank' WHEN f.field = 'beam_type' AND c.id % 3 = 1 THEN 'conflict' WHEN f.field = 'folder_name' AND c.id % 4 = 1 THEN 'code_update' ELSE 'noop' END AS action
FROM irradiation_campaigns c, (VALUES ('facility'), ('beam_type'), ('folder_name')) f(field)
WHERE c.facility IS NOT NULL AND c.beam_type IS NOT NULL AND c.folder_name IS NOT NULL""")
def _(t):
    seed = t("irradiation_campaigns").filter("facility IS NOT NULL AND beam_type IS NOT NULL AND folder_name IS NOT NULL").select("id", "facility", "beam_type", "folder_name")
    there = seed.filter("id % 6 <> 0").select("id", F.expr("CASE WHEN id % 2 = 0 THEN '' ELSE facility END").alias("facility"), F.expr("CASE WHEN id % 3 = 1 THEN 'other' ELSE beam_type END").alias("beam_type"), F.expr("CASE WHEN id % 4 = 1 THEN 'old' ELSE folder_name END").alias("folder_name"))
    return sinks.reconcile(there, seed, ["id"], ["facility", "beam_type", "folder_name"], owned=("folder_name",)).select("id", "field", "action")


# ---- files as texts


def _sampled(files, samples):
    """(path, content) of the files as a curve tracer writes them: group, header and the sampled rows."""
    rows = samples.filter("cells IS NOT NULL").groupBy("metadata_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"]), "\n").alias("body"))
    return files.join(rows, files.id == rows.metadata_id).select(F.col("id").cast("string").alias("path"), F.concat_ws("\n", F.lit("GROUP 1"), "columns", "body").alias("content"))


@query("src_curve_csv", r"""
WITH f AS (SELECT id, string_split(columns, ',') AS h FROM baselines_metadata WHERE regexp_matches(columns, '^[^;|\t]*$') AND NOT contains(columns, '(')), s AS (SELECT metadata_id, row_no, string_split(cells, ',') AS c FROM file_samples),
x AS (SELECT f.id, s.row_no, unnest(h) AS b, unnest(c) AS v FROM f JOIN s ON s.metadata_id = f.id WHERE len(h) = len(c)),
y AS (SELECT id, row_no, regexp_replace(lower(trim(regexp_replace(b, '\[[^\]]*\]', '', 'g'))), '\s+', '_', 'g') AS b, try_cast(trim(v) AS DOUBLE) AS v FROM x),
z AS (SELECT id, row_no, max(v) FILTER (WHERE b IN ('v_gate', 'vg', 'vgs')) AS v_gate, max(v) FILTER (WHERE b IN ('v_drain', 'vd', 'vds')) AS v_drain, max(v) FILTER (WHERE b IN ('i_drain', 'id', 'ids')) AS i_drain,
  count(v) FILTER (WHERE b IN ('v_gate', 'vg', 'vgs', 'i_gate', 'ig', 'igs', 'v_drain', 'vd', 'vds', 'i_drain', 'id', 'ids', 'rds', 'bv', 'time', 't')) AS n FROM y GROUP BY ALL)
SELECT CAST(id AS VARCHAR) AS path, count(*) AS rows, round(sum(v_gate), 6) AS v_gate, round(sum(v_drain), 6) AS v_drain FROM z WHERE n > 0 GROUP BY 1""")
def _(t):
    f = t("baselines_metadata").filter(F.col("columns").rlike(r"^[^;|\t]*$") & ~F.contains("columns", F.lit("("))).select("id", "columns")
    p = text_files.curve_csv(_sampled(f, t("file_samples")))
    return p.groupBy("path").agg(F.count("*").alias("rows"), r(F.sum("v_gate")).alias("v_gate"), r(F.sum("v_drain")).alias("v_drain"))


@query("src_curve_csv_all", r"""
WITH f AS (SELECT id, CASE WHEN contains(columns, ';') THEN ';' WHEN contains(columns, '|') THEN '|' WHEN contains(columns, chr(9)) THEN chr(9) ELSE ',' END AS sep, columns FROM baselines_metadata WHERE columns IS NOT NULL),
x AS (SELECT f.id, s.row_no, unnest(string_split(columns, sep)) AS b, unnest(string_split(cells, sep)) AS v FROM f JOIN file_samples s ON s.metadata_id = f.id WHERE len(string_split(columns, sep)) = len(string_split(cells, sep))),
y AS (SELECT id, row_no, coalesce(try_cast(nullif(regexp_extract(b, '\(([0-9]+)\)', 1), '') AS INTEGER), 1) AS step, regexp_replace(lower(trim(regexp_replace(b, '\([^)]*\)|\[[^\]]*\]', '', 'g'))), '\s+', '_', 'g') AS b, try_cast(trim(v) AS DOUBLE) AS v FROM x),
z AS (SELECT id, row_no, step, max(v) FILTER (WHERE b IN ('v_gate', 'vg', 'vgs')) AS v_gate, max(v) FILTER (WHERE b IN ('v_drain', 'vd', 'vds')) AS v_drain, max(v) FILTER (WHERE b IN ('i_drain', 'id', 'ids')) AS i_drain,
  count(v) FILTER (WHERE b IN ('v_gate', 'vg', 'vgs', 'i_gate', 'ig', 'igs', 'v_drain', 'vd', 'vds', 'i_drain', 'id', 'ids', 'rds', 'bv', 'time', 't')) AS n FROM y WHERE NOT isnan(coalesce(v, 0)) GROUP BY ALL)
SELECT CAST(id AS VARCHAR) AS path, step, count(*) AS rows, round(sum(v_gate), 6) AS v_gate, round(sum(v_drain), 6) AS v_drain, round(sum(i_drain), 6) AS i_drain FROM z WHERE n > 0 GROUP BY ALL""")
def _(t):
    p = text_files.curve_csv(_sampled(t("baselines_metadata").filter("columns IS NOT NULL"), t("file_samples")), separator=None)
    return p.groupBy("path", "step").agg(F.count("*").alias("rows"), r(F.sum("v_gate")).alias("v_gate"), r(F.sum("v_drain")).alias("v_drain"), r(F.sum("i_drain")).alias("i_drain"))


@query("src_script_parameters", r"""
SELECT doc_id, try_cast(nullif(regexp_extract(text, '(?i)\.limiti\s*=\s*([-+0-9.eE]+)', 1), '') AS DOUBLE) AS compliance, try_cast(nullif(regexp_extract(text, '(?i)\.nplc\s*=\s*([-+0-9.eE]+)', 1), '') AS DOUBLE) AS plc,
  try_cast(nullif(regexp_extract(text, '(?i)\bdelay\(\s*([-+0-9.eE]+)\s*\)', 1), '') AS DOUBLE) AS delay FROM documents WHERE source = 'tsp_script' AND text IS NOT NULL""")
def _(t):
    docs = t("documents").filter("source = 'tsp_script' AND text IS NOT NULL")
    return text_files.script_parameters(docs, "doc_id", "text").select("doc_id", "compliance", "plc", "delay")


@query("src_settings", r"""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line FROM documents WHERE source = 'tsp_script' AND text IS NOT NULL),
k AS (SELECT doc_id, regexp_extract(line, '^\s*([A-Za-z_][A-Za-z0-9_ .]*?)\s*[=:]\s*(.*?)\s*$', 1) AS key FROM l WHERE trim(line) <> '') SELECT doc_id, count(*) AS settings, count(DISTINCT key) AS keys FROM k WHERE key <> '' GROUP BY 1""")
def _(t):
    s = text_files.settings(t("documents").filter("source = 'tsp_script' AND text IS NOT NULL").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    return s.groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("settings"), F.count_distinct("key").alias("keys"))


@query("src_decimated", """
WITH d AS (SELECT DISTINCT metadata_id, point_index FROM baselines_measurements), s AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY metadata_id) / 50.0) AS BIGINT) AS stride FROM d) SELECT metadata_id, point_index FROM s WHERE point_index % stride = 0""")
def _(t):
    return binary_files.decimated(t("baselines_measurements").select("metadata_id", "point_index").distinct(), ["metadata_id"], "point_index", 50)


@query("src_channel_roles", """
WITH p AS (SELECT metadata_id, unnest(['i_drain', 'i_gate', 'v_drain', 'v_gate']) AS channel, unnest(['A', 'A', 'V', 'V']) AS unit, unnest([max(abs(i_drain)) FILTER (WHERE abs(i_drain) < 1e30), max(abs(i_gate)) FILTER (WHERE abs(i_gate) < 1e30), max(abs(v_drain)) FILTER (WHERE abs(v_drain) < 1e30), max(abs(v_gate)) FILTER (WHERE abs(v_gate) < 1e30)]) AS peak FROM baselines_measurements GROUP BY 1),
n AS (SELECT metadata_id, channel, unit, row_number() OVER (PARTITION BY metadata_id, unit ORDER BY peak DESC, channel) AS s, row_number() OVER (PARTITION BY metadata_id, unit ORDER BY channel) AS k, row_number() OVER (PARTITION BY metadata_id, unit ORDER BY channel DESC) AS l FROM p WHERE peak IS NOT NULL)
SELECT metadata_id, channel, CASE WHEN unit = 'A' THEN CASE s WHEN 1 THEN 'i_drain' WHEN 2 THEN 'i_gate' END WHEN k = 1 THEN 'v_drain' WHEN l = 1 THEN 'v_gate' END AS role FROM n""")
def _(t):
    p = cleaning.cleaned(t("baselines_measurements")).groupBy("metadata_id").agg(*(F.max(F.abs(c)).alias(c) for c in cleaning.CHANNELS))
    flat = p.select("metadata_id", F.inline(F.array(*(F.struct(F.lit(c).alias("channel"), F.lit("A" if c[0] == "i" else "V").alias("unit"), F.col(c).alias("peak")) for c in cleaning.CHANNELS)))).filter("peak IS NOT NULL")
    return binary_files.channel_roles(flat, ["metadata_id"])


@query("src_companions", r"""
WITH p AS (SELECT DISTINCT csv_path, string_split(replace(lower(csv_path), chr(92), '/'), '/') AS a FROM baselines_metadata WHERE csv_path IS NOT NULL), s AS (SELECT csv_path, a, regexp_replace(a[-1], '[.][^.]*$', '') AS stem FROM p),
v AS (SELECT csv_path, a, unnest([0, 1, 2]) AS variant, unnest([stem, regexp_replace(stem, '_append[0-9]*$', ''), regexp_replace(stem, '^[0-9]+_', '')]) AS stem FROM s), u AS (SELECT *, unnest(range(0, 5)) AS up FROM v),
w AS (SELECT csv_path, variant, up, array_to_string(a[1:len(a) - 1 - up], '/') || '/' || stem || '.tsp' AS want FROM u WHERE len(a) > up + 1),
l AS (SELECT DISTINCT tsp_path AS companion, replace(lower(tsp_path), chr(92), '/') AS k FROM baselines_metadata WHERE tsp_path IS NOT NULL)
SELECT csv_path, companion FROM (SELECT csv_path, companion, row_number() OVER (PARTITION BY csv_path ORDER BY variant, up, companion) AS n FROM w JOIN l ON l.k = w.want) WHERE n = 1""")
def _(t):
    f = t("baselines_metadata")
    return listing.companions(f.filter("csv_path IS NOT NULL").select("csv_path").distinct(), f.filter("tsp_path IS NOT NULL").select(F.col("tsp_path").alias("path")).distinct(), "csv_path", "tsp", folder=None)


@query("src_remapped", """
WITH m AS (SELECT csv_path, file_hash, sample_group FROM baselines_metadata WHERE ingest_batch >= 5), a AS (SELECT csv_path, v FROM (SELECT csv_path, sample_group AS v, row_number() OVER (PARTITION BY csv_path ORDER BY count(*) DESC, sample_group) AS k FROM m WHERE sample_group IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
b AS (SELECT file_hash, v FROM (SELECT file_hash, sample_group AS v, row_number() OVER (PARTITION BY file_hash ORDER BY count(*) DESC, sample_group) AS k FROM m WHERE sample_group IS NOT NULL GROUP BY 1, 2) WHERE k = 1)
SELECT f.id, coalesce(a.v, b.v, f.experiment) AS experiment FROM baselines_metadata f LEFT JOIN a ON a.csv_path = f.csv_path LEFT JOIN b ON b.file_hash = f.file_hash WHERE f.ingest_batch < 5""")
def _(t):
    f = t("baselines_metadata")
    m = f.filter("ingest_batch >= 5").select("csv_path", "file_hash", F.col("sample_group").alias("experiment"))
    return listing.remapped(f.filter("ingest_batch < 5"), m, "csv_path", "file_hash", "experiment").select("id", "experiment")


# ---- functions


@query("fn_parsing", r"""
WITH n AS (SELECT id, filename, nullif(regexp_extract(filename, '(?i)(?:^|[^A-Za-z0-9])W([0-9]+)[_ -]?C[0-9]+', 1), '') AS w, nullif(regexp_extract(filename, '(?i)(?:^|[^A-Za-z0-9])W[0-9]+[_ -]?C([0-9]+)', 1), '') AS c FROM baselines_metadata)
SELECT id, CASE WHEN w IS NOT NULL THEN 'W' || lpad(w, CAST(greatest(length(w), 2) AS INTEGER), '0') || '_C' || lpad(c, CAST(greatest(length(c), 2) AS INTEGER), '0') END AS chip, try_cast(nullif(regexp_extract(filename, '(?i)_(-?[0-9.]+)V[_.]', 1), '') AS DOUBLE) AS bias,
  CASE WHEN filename IS NULL THEN NULL WHEN regexp_matches(filename, '(?i)id[ _-]?vg|transfer') THEN 'IdVg' WHEN regexp_matches(filename, '(?i)idvdss') THEN 'Blocking' WHEN regexp_matches(filename, '(?i)id[ _-]?vd|output') THEN 'IdVd' WHEN regexp_matches(filename, '(?i)block|bvdss') THEN 'Blocking' WHEN regexp_matches(filename, '(?i)igss|gate[ _-]?leak') THEN 'Igss'
    WHEN regexp_matches(filename, '(?i)rds[ _-]?\(?on') THEN 'Rdson' WHEN regexp_matches(filename, '(?i)vth|threshold') THEN 'Vth' WHEN regexp_matches(filename, '(?i)irrad|beam') THEN 'Irradiation' ELSE 'Other' END AS category FROM n""")
def _(t):
    f = F.col("filename")
    return t("baselines_metadata").select("id", parsing.chip(f).alias("chip"), parsing.bias(f).alias("bias"), parsing.category(f).alias("category"))


@query("fn_temperature", r"""
SELECT doc_id, try_cast(nullif(regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9])(-?[0-9]+(?:\.[0-9]+)?) ?(?:°C|degC)', 1), '') AS DOUBLE) AS celsius FROM documents WHERE regexp_matches(text, '[0-9] ?°C') AND NOT regexp_matches(text, '(?i)(^|[^A-Za-z0-9])-?[0-9]+(\.[0-9]+)? ?C([^A-Za-z0-9]|$)')""")
def _(t):
    d = t("documents").filter(F.col("text").rlike("[0-9] ?°C") & ~F.col("text").rlike(r"(?i)(^|[^A-Za-z0-9])-?[0-9]+(\.[0-9]+)? ?C([^A-Za-z0-9]|$)"))
    return d.select("doc_id", parsing.temperature(F.col("text")).alias("celsius"))


@query("fn_depletion", f"""
WITH v AS (SELECT id, bias_value AS v, 2 * {physics.EPSILON} * 1200 / ({physics.CHARGE} * 1e-3 * 1e-3) AS n FROM baselines_metadata WHERE bias_value > 0)
SELECT id, round(sqrt(2 * {physics.EPSILON} * v / ({physics.CHARGE} * n)) * 1e4, 6) AS width_um, round(sqrt(2 * {physics.EPSILON} * {physics.CHARGE} * n * pow(v, 3)) / 3 * 1e6, 6) AS energy_uj, round(pow(pow(3 * 207e-6, 2) / (2 * {physics.EPSILON} * {physics.CHARGE} * n), 1.0 / 3), 4) AS critical_v FROM v""")
def _(t):
    n = physics.doping(F.lit(1200.0), F.lit(1e-3))
    v = F.col("bias_value")
    return t("baselines_metadata").filter("bias_value > 0").select("id", r(physics.depletion_width(v, n) * 1e4).alias("width_um"), r(physics.stored_energy(v, n) * 1e6).alias("energy_uj"), r(physics.critical_voltage(F.lit(207e-6), n), 4).alias("critical_v"))


@query("fn_uncertainty", """
SELECT id, round(bias_value / exp(sqrt(0.01 + coalesce(plc * plc, 0) / 100)), 6) AS low, round(bias_value * exp(sqrt(0.01 + coalesce(plc * plc, 0) / 100)), 6) AS high FROM baselines_metadata WHERE bias_value > 0""")
def _(t):
    s = intervals.combined_sigma(F.lit(0.1), F.col("plc") / 10)
    i = intervals.log_interval(F.col("bias_value"), s)
    return t("baselines_metadata").filter("bias_value > 0").select("id", r(i["low"]).alias("low"), r(i["high"]).alias("high"))


@query("fn_json", """
SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS has_k FROM events""")
def _(t):
    k = F.get_json_object("props", "$.k")
    return t("events").select("event_id", k.alias("k"), k.isNotNull().alias("has_k"))


@query("fn_dates", """
SELECT f.id, c.id AS campaign, f.measured_on - c.date_start AS days, measured_on BETWEEN c.date_start AND c.date_end AS during FROM baselines_metadata f JOIN irradiation_campaigns c ON c.id = f.irrad_campaign_id WHERE measured_on IS NOT NULL AND date_start IS NOT NULL""")
def _(t):
    c = t("irradiation_campaigns").select(F.col("id").alias("campaign"), "date_start", "date_end").filter("date_start IS NOT NULL")
    f = t("baselines_metadata").filter("measured_on IS NOT NULL").withColumnRenamed("irrad_campaign_id", "campaign")
    return join_dimension(f, c, "campaign").select("id", "campaign", F.datediff("measured_on", "date_start").cast("long").alias("days"), F.col("measured_on").between(F.col("date_start"), F.col("date_end")).alias("during"))


# ---- serving and streams


@query("serve_chart", """
WITH f AS (SELECT * FROM baselines_metadata WHERE num_points > 0 AND device_id IS NOT NULL), s AS (SELECT device_id FROM f GROUP BY 1 ORDER BY count(DISTINCT experiment) DESC, device_id LIMIT 5)
SELECT measurement_category, device_id, count(*) AS files, max(abs(bias_value)) AS most_bias, round(avg(num_points), 6) AS points FROM f WHERE device_id IN (SELECT device_id FROM s) GROUP BY ALL""")
def _(t):
    return bounds.chart_query(t("baselines_metadata"), ["measurement_category"], {"files": "count(*)", "most_bias": "max(abs(bias_value))", "points": "round(avg(num_points), 6)"}, ["device_id"], "num_points > 0 AND device_id IS NOT NULL", series_limit=5, series_metric="count(DISTINCT experiment)")


@query("serve_sparse_ranks", """
SELECT data_source, measurement_category, count(*) AS files FROM baselines_metadata WHERE measurement_category IS NOT NULL GROUP BY ALL ORDER BY data_source NULLS FIRST, measurement_category LIMIT 12""")
def _(t):
    return bounds.chart_query(t("baselines_metadata"), ["data_source", "measurement_category"], {"files": "count(*)"}, where="measurement_category IS NOT NULL", limit=12)


@query("stream_tumbling", """
SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS "begin", count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def _(t):
    w = stream.tumbling(t("events"), "1 hour")
    return w.select("event_type", F.col("begin").cast("timestamp_ntz").alias("begin"), "n", r("total", 4).alias("total"))


@query("stream_sessions", """
WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT user_id, min(ts) AS "begin", max(ts) AS "end", count(*) AS n FROM b GROUP BY user_id, s""")
def _(t):
    s = stream.sessions(t("events"), "30 minutes")
    return s.select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


QUERIES, SQL = query.queries, query.sql
