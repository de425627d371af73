"""Queries over the projections, joins, aggregates, windows, orderings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ohmgrid.operators import cleaning, joins, series, statistics
from ohmgrid.plans.base import Registry
from ohmgrid.session import join_dimension
from ohmgrid.sources import listing, sinks

query = Registry()
CLEAN = ", ".join(f"CASE WHEN abs({c}) < 1e30 THEN {c} END AS {c}" for c in cleaning.CHANNELS)


def r(c, digits: int = 6):
    """Rounded for comparison."""
    return F.round(c, digits)


# ---- projections and filters


@query("proj_sentinels", f"""
WITH c AS (SELECT metadata_id, {CLEAN} FROM baselines_measurements)
SELECT metadata_id, count(v_gate) AS n_v_gate, count(i_gate) AS n_i_gate, count(v_drain) AS n_v_drain, count(i_drain) AS n_i_drain, max(v_gate) AS max_v_gate, min(i_drain) AS min_i_drain
FROM c GROUP BY metadata_id""")
def _(t):
    c = cleaning.cleaned(t("baselines_measurements"))
    return c.groupBy("metadata_id").agg(*(F.count(x).alias(f"n_{x}") for x in cleaning.CHANNELS), F.max("v_gate").alias("max_v_gate"), F.min("i_drain").alias("min_i_drain"))


@query("proj_plot_bins", f"""
SELECT f.measurement_category, v_gate_bin, v_drain_bin, count(*) AS points FROM (
  SELECT f.measurement_category, CASE WHEN f.measurement_category IN ('IdVd', '3rd_Quadrant') THEN g0 ELSE g1 END AS v_gate_bin,
    CASE WHEN f.measurement_category IN ('IdVg', 'Vth') AND f.drain_bias_value IS NOT NULL THEN CAST(round(CAST(f.drain_bias_value AS DECIMAL(28,9)), 1) AS DOUBLE)
         WHEN f.measurement_category = 'Blocking' THEN d0 ELSE d1 END AS v_drain_bin
  FROM (SELECT metadata_id, {', '.join(f"CASE WHEN abs({c}) < 1e30 THEN CAST(round(CAST({c} AS DECIMAL(28,9)), {d}) AS DOUBLE) END AS {n}{d}" for c, n in (("v_gate", "g"), ("v_drain", "d")) for d in (0, 1))}
        FROM baselines_measurements WHERE (v_gate IS NULL OR abs(v_gate) < 1e15 OR abs(v_gate) >= 1e30) AND (v_drain IS NULL OR abs(v_drain) < 1e15 OR abs(v_drain) >= 1e30)) p
  JOIN baselines_metadata f ON f.id = p.metadata_id) f
GROUP BY ALL""")
def _(t):
    f = t("baselines_metadata").select(F.col("id").alias("metadata_id"), "measurement_category", "drain_bias_value")
    p = cleaning.cleaned(t("baselines_measurements").select("metadata_id", *cleaning.CHANNELS)).join(f, "metadata_id")
    cat = F.col("measurement_category")
    gate = F.when(cat.isin("IdVd", "3rd_Quadrant"), cleaning.half_up("v_gate", 0)).otherwise(cleaning.half_up("v_gate", 1))
    swept = cat.isin("IdVg", "Vth") & F.col("drain_bias_value").isNotNull()
    drain = F.when(swept, cleaning.half_up("drain_bias_value", 1)).when(cat == "Blocking", cleaning.half_up("v_drain", 0)).otherwise(cleaning.half_up("v_drain", 1))
    return p.groupBy("measurement_category", gate.alias("v_gate_bin"), drain.alias("v_drain_bin")).agg(F.count("*").alias("points"))


@query("proj_compliance", """
WITH c AS (SELECT metadata_id, CASE WHEN abs(i_drain) < 1e30 THEN i_drain END AS i FROM baselines_measurements), m AS (SELECT metadata_id, max(abs(i)) AS most FROM c GROUP BY 1)
SELECT c.metadata_id, count(*) AS points, count(i) AS currents FROM c JOIN m USING (metadata_id) WHERE i IS NULL OR most IS NULL OR abs(i) < 0.99 * most GROUP BY 1""")
def _(t):
    kept = cleaning.below_compliance(cleaning.cleaned(t("baselines_measurements").select("metadata_id", "i_drain"), ("i_drain",)))
    return kept.groupBy("metadata_id").agg(F.count("*").alias("points"), F.count("i_drain").alias("currents"))


@query("proj_ladder_flags", """
SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 150000 THEN 'mid' ELSE 'high' END AS band,
  concat_ws(',', CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END) AS marks,
  CAST(coalesce(o_orderstatus = 'O', false) AS BIGINT) + CAST(coalesce(o_totalprice > 300000, false) AS BIGINT) + CAST(coalesce(o_orderpriority LIKE '1%', false) AS BIGINT) AS n_marks
FROM orders""")
def _(t):
    marks = cleaning.flags(open=F.col("o_orderstatus") == "O", large=F.col("o_totalprice") > 300000, urgent=F.col("o_orderpriority").like("1%"))
    return t("orders").select("o_orderkey", cleaning.ladder(F.col("o_totalprice"), [(50000, "low"), (150000, "mid")], "high").alias("band"), F.array_join(marks, ",").alias("marks"), F.size(marks).cast("long").alias("n_marks"))


@query("proj_keys", """
SELECT id, concat_ws(':', coalesce(nullif(data_source, ''), 'baselines'), coalesce(CAST(irrad_campaign_id AS VARCHAR), nullif(experiment, ''), 'no-context'), coalesce(nullif(sample_group, ''), nullif(device_id, ''), 'file-' || id)) AS device_key
FROM baselines_metadata""")
def _(t):
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    key = F.concat_ws(":", F.coalesce(blank("data_source"), F.lit("baselines")), F.coalesce(F.col("irrad_campaign_id").cast("string"), blank("experiment"), F.lit("no-context")), F.coalesce(blank("sample_group"), blank("device_id"), F.concat(F.lit("file-"), "id")))
    return t("baselines_metadata").select("id", key.alias("device_key"))


@query("proj_regex_null_safe", r"""
SELECT id, regexp_matches(filename, '(?i)_(fwd|rev)_[0-9]+V_') AS named, csv_path ILIKE '%station%' AS station, data_source IS DISTINCT FROM 'baselines' AS other,
  regexp_extract(filename, '_([0-9]+)V_', 1) AS bias, coalesce(is_likely_irradiated, false) AS irradiated
FROM baselines_metadata""")
def _(t):
    return t("baselines_metadata").select(
        "id", F.col("filename").rlike("(?i)_(fwd|rev)_[0-9]+V_").alias("named"), F.col("csv_path").ilike("%station%").alias("station"), (~F.col("data_source").eqNullSafe("baselines")).alias("other"),
        F.regexp_extract("filename", "_([0-9]+)V_", 1).alias("bias"), F.coalesce("is_likely_irradiated", F.lit(False)).alias("irradiated"),
    )


@query("proj_dynamic_filter", """
SELECT id, data_source, measurement_category FROM baselines_metadata
WHERE (coalesce(data_source, 'baselines') = 'baselines' OR irrad_role = 'pre_irrad') AND NOT coalesce(is_likely_irradiated, false) AND num_points BETWEEN 50 AND 200""")
def _(t):
    wanted = {"source": "baselines", "points": (50, 200)}
    cond = (F.coalesce("data_source", F.lit("baselines")) == wanted["source"]) | (F.col("irrad_role") == "pre_irrad")
    cond &= ~F.coalesce("is_likely_irradiated", F.lit(False))
    cond &= F.col("num_points").between(*wanted["points"])
    return t("baselines_metadata").filter(cond).select("id", "data_source", "measurement_category")


# ---- joins


@query("join_fact_dimension", """
SELECT f.data_source, l.device_category, count(*) AS files, CAST(sum(f.num_points) AS BIGINT) AS points FROM baselines_metadata f LEFT JOIN device_library l ON f.device_id = l.part_number GROUP BY ALL""")
def _(t):
    lib = t("device_library").select(F.col("part_number").alias("device_id"), "device_category")  # a fixed list
    return join_dimension(t("baselines_metadata"), lib, "device_id", how="left").groupBy("data_source", "device_category").agg(F.count("*").alias("files"), F.sum("num_points").alias("points"))


@query("join_null_safe", """
WITH a AS (SELECT experiment, measurement_category, data_source, count(*) AS files FROM baselines_metadata GROUP BY ALL), b AS (SELECT measurement_category, data_source, max(num_points) AS most FROM baselines_metadata GROUP BY ALL)
SELECT a.*, b.most FROM a JOIN b ON a.measurement_category IS NOT DISTINCT FROM b.measurement_category AND a.data_source IS NOT DISTINCT FROM b.data_source""")
def _(t):
    f = t("baselines_metadata")
    a = f.groupBy("experiment", "measurement_category", "data_source").agg(F.count("*").alias("files"))
    b = f.groupBy("measurement_category", "data_source").agg(F.max("num_points").alias("most"))
    return joins.null_safe(a, b, ["measurement_category", "data_source"])


@query("join_by_discriminator", """
WITH k AS (SELECT 'irradiation|' || id AS key, campaign_name AS label FROM irradiation_campaigns UNION ALL SELECT DISTINCT 'avalanche|' || sample_group, sample_group FROM baselines_metadata WHERE sample_group IS NOT NULL)
SELECT f.id, k.label FROM baselines_metadata f LEFT JOIN k ON (f.data_source = 'irradiation' AND f.irrad_campaign_id IS NOT NULL AND k.key = 'irradiation|' || f.irrad_campaign_id) OR (f.data_source = 'avalanche' AND f.sample_group IS NOT NULL AND k.key = 'avalanche|' || f.sample_group)""")
def _(t):
    f = t("baselines_metadata").select("id", "data_source", "irrad_campaign_id", "sample_group")
    one = t("irradiation_campaigns").select(F.concat(F.lit("irradiation|"), F.col("id").cast("string")).alias("key"), F.col("campaign_name").alias("label"))
    two = f.filter("sample_group IS NOT NULL").select(F.concat(F.lit("avalanche|"), "sample_group").alias("key"), F.col("sample_group").alias("label")).distinct()
    return joins.by_discriminator(f, one.unionByName(two), "data_source", {"irradiation": "irrad_campaign_id", "avalanche": "sample_group"}).select("id", "label")


@query("join_case_insensitive", """
SELECT f.id, l.part_number FROM baselines_metadata f JOIN device_library l ON lower(trim(f.device_id)) = lower(l.part_number)""")
def _(t):
    f = t("baselines_metadata").withColumn("k", F.lower(F.trim("device_id")))
    return f.join(t("device_library").select("part_number", F.lower("part_number").alias("k")), "k").select("id", "part_number")


@query("join_unequal_guarded", """
WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000), s AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000),
own AS (SELECT DISTINCT c_custkey FROM c JOIN s ON c_nationkey = s_nationkey)
SELECT c.c_custkey, s.s_suppkey FROM c JOIN nation n ON c_nationkey = n_nationkey JOIN nation o ON n.n_regionkey = o.n_regionkey AND n.n_nationkey <> o.n_nationkey JOIN s ON s_nationkey = o.n_nationkey WHERE c.c_custkey NOT IN (SELECT c_custkey FROM own)""")
def _(t):
    c, s, n = t("customer").filter("c_acctbal > 9000"), t("supplier").filter("s_acctbal > 5000"), t("nation")
    lonely = c.join(s, c.c_nationkey == s.s_nationkey, "left_anti")
    home, other = n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), n.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return lonely.join(home, "c_nationkey").join(other, "n_regionkey").filter("c_nationkey <> s_nationkey").join(s, "s_nationkey").select("c_custkey", "s_suppkey")


@query("join_interval", """
WITH p AS (SELECT DISTINCT metadata_id, point_index, time_val FROM baselines_measurements WHERE abs(time_val) < 1e30), w AS (SELECT metadata_id, min(time_val) + 10 AS first, min(time_val) + 40 AS last FROM p GROUP BY 1)
SELECT p.metadata_id, count(*) AS points, min(p.point_index) AS first_point, max(p.point_index) AS last_point FROM p JOIN w ON p.metadata_id = w.metadata_id AND p.time_val BETWEEN w.first AND w.last GROUP BY 1""")
def _(t):
    p = t("baselines_measurements").select("metadata_id", "point_index", "time_val").filter("abs(time_val) < 1e30").distinct()
    w = p.groupBy("metadata_id").agg((F.min("time_val") + 10).alias("first"), (F.min("time_val") + 40).alias("last"))
    hit = joins.points_in_intervals(p, w, ["metadata_id"], "time_val", width=10.0)
    return hit.groupBy("metadata_id").agg(F.count("*").alias("points"), F.min("point_index").alias("first_point"), F.max("point_index").alias("last_point"))


@query("join_interval_overlap", """
WITH i AS (SELECT o_custkey, min(o_totalprice) AS low1, max(o_totalprice) AS high1, min(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS low2, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS high2 FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN low1 IS NULL OR high1 IS NULL OR low2 IS NULL OR high2 IS NULL OR low1 > high1 OR low2 > high2 THEN 'missing_interval'
  WHEN least(high1, high2) >= greatest(low1, low2) THEN CASE WHEN least(high1, high2) - greatest(low1, low2) >= 0.5 * least(high1 - low1, high2 - low2) THEN 'strong_overlap' ELSE 'partial_overlap' END
  WHEN greatest(low1, low2) - least(high1, high2) <= least(high1 - low1, high2 - low2) THEN 'near_miss' ELSE 'far_miss' END AS overlap FROM i""")
def _(t):
    from ohmgrid.functions.intervals import overlap

    done = F.col("o_orderstatus") == "F"
    i = t("orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("low1"), F.max("o_totalprice").alias("high1"), F.min(F.when(done, F.col("o_totalprice"))).alias("low2"), F.max(F.when(done, F.col("o_totalprice"))).alias("high2"))
    return i.select("o_custkey", overlap("low1", "high1", "low2", "high2").alias("overlap"))


@query("join_settings", """
WITH s AS (SELECT avg(l_quantity) AS middle FROM lineitem) SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > s.middle) AS above, count(*) AS lines FROM lineitem, s GROUP BY 1""")
def _(t):
    items = t("lineitem")
    middle = items.agg(F.avg("l_quantity").alias("middle"))  # one row
    return items.crossJoin(F.broadcast(middle)).groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > F.col("middle")).alias("above"), F.count("*").alias("lines"))


@query("join_self_pairs", """
WITH q AS (SELECT c_mktsegment, n_regionkey, count(*) AS n, round(avg(c_acctbal), 6) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT a.c_mktsegment, a.n_regionkey AS region_a, b.n_regionkey AS region_b, a.n - b.n AS more, round(a.balance - b.balance, 5) AS richer FROM q a JOIN q b ON a.c_mktsegment = b.c_mktsegment AND a.n_regionkey < b.n_regionkey""")
def _(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    q = c.groupBy("c_mktsegment", "n_regionkey").agg(F.count("*").alias("n"), r(F.avg("c_acctbal")).alias("balance"))
    b = q.select("c_mktsegment", F.col("n_regionkey").alias("region_b"), F.col("n").alias("n_b"), F.col("balance").alias("balance_b"))
    j = q.withColumnRenamed("n_regionkey", "region_a").join(b, "c_mktsegment").filter("region_a < region_b")
    return j.select("c_mktsegment", "region_a", "region_b", (F.col("n") - F.col("n_b")).alias("more"), r(F.col("balance") - F.col("balance_b"), 5).alias("richer"))


@query("join_top_one", """
SELECT p_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT p_partkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY p_partkey ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_suppkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey) WHERE n = 1""")
def _(t):
    items = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    best = joins.top_one(t("part").select("p_partkey"), items, ["p_partkey"], ["p_partkey"], [F.desc_nulls_last("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")])
    return best.select("p_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("join_fan_out", """
SELECT o_orderkey, role, who FROM (SELECT o_orderkey, unnest(['customer', 'clerk']) AS role, unnest([CAST(o_custkey AS VARCHAR), o_orderpriority]) AS who FROM orders) WHERE who IS NOT NULL""")
def _(t):
    roles = F.array(F.struct(F.lit("customer").alias("role"), F.col("o_custkey").cast("string").alias("who")), F.struct(F.lit("clerk").alias("role"), F.col("o_orderpriority").alias("who")))
    return t("orders").select("o_orderkey", F.inline(roles)).filter("who IS NOT NULL")


@query("join_anti_semi", """
SELECT 'without orders' AS kind, count(*) AS customers FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'with urgent', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')
UNION ALL SELECT 'pair absent', count(*) FROM supplier WHERE (s_nationkey, s_suppkey) NOT IN (SELECT c_nationkey, c_custkey FROM customer)""")
def _(t):
    c, o, s = t("customer"), t("orders"), t("supplier")
    n = lambda kind, df: df.agg(F.count("*").alias("customers")).select(F.lit(kind).alias("kind"), "customers")
    on = c.c_custkey == o.o_custkey
    return n("without orders", c.join(o, on, "left_anti")).unionByName(n("with urgent", c.join(o.filter("o_orderpriority LIKE '1%'"), on, "left_semi"))).unionByName(n("pair absent", s.join(c, (s.s_nationkey == c.c_nationkey) & (s.s_suppkey == c.c_custkey), "left_anti")))


@query("join_rules", """
WITH d AS (SELECT id, device_id, coalesce(data_source, 'baselines') AS source FROM baselines_metadata),
m AS (SELECT d.id, r.part_number, row_number() OVER (PARTITION BY d.id ORDER BY r.priority DESC, length(r.pattern) DESC, r.id) AS n FROM d JOIN device_mapping_rules r
  ON (r.scope = 'all' OR CASE r.scope WHEN 'sc' THEN 'sc_ruggedness' ELSE r.scope END = d.source) AND CASE r.pattern_type WHEN 'substring' THEN contains(upper(d.device_id), upper(r.pattern)) ELSE regexp_matches(d.device_id, '(?i)' || r.pattern) END)
SELECT d.id, m.part_number FROM d LEFT JOIN m ON d.id = m.id AND m.n = 1""")
def _(t):
    d = t("baselines_metadata").select("id", "device_id", F.coalesce("data_source", F.lit("baselines")).alias("source"))
    rules = t("device_mapping_rules").withColumn("scope", F.when(F.col("scope") == "sc", "sc_ruggedness").otherwise(F.col("scope")))  # the only scope not named as its data_source
    return joins.by_rules(d, rules, "device_id", "source", "part_number").select("id", "part_number")


@query("join_fallback", """
WITH a AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer WHERE c_acctbal > 9900 GROUP BY ALL), b AS (SELECT c_nationkey, min(c_custkey) AS k FROM customer WHERE c_acctbal > 9900 GROUP BY 1), c AS (SELECT c_mktsegment, min(c_custkey) AS k FROM customer WHERE c_acctbal > 9900 GROUP BY 1)
SELECT x.id, coalesce(a.k, b.k, c.k) AS c_custkey, CASE WHEN a.k IS NOT NULL THEN 'c_nationkey+c_mktsegment' WHEN b.k IS NOT NULL THEN 'c_nationkey' WHEN c.k IS NOT NULL THEN 'c_mktsegment' END AS matched_by
FROM (SELECT c_custkey AS id, c_nationkey, c_mktsegment FROM customer) x LEFT JOIN a USING (c_nationkey, c_mktsegment) LEFT JOIN b USING (c_nationkey) LEFT JOIN c USING (c_mktsegment)""")
def _(t):
    c = t("customer")
    left = c.select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    return joins.fallback(left, c.filter("c_acctbal > 9900"), [["c_nationkey", "c_mktsegment"], ["c_nationkey"], ["c_mktsegment"]], "c_custkey").select("id", "c_custkey", "matched_by")


@query("join_nearest", """
WITH j AS (SELECT c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal) / 1000, 9) AS distance FROM customer JOIN supplier ON c_nationkey = s_nationkey),
n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY distance, s_suppkey) AS rank FROM j) SELECT c_custkey, s_suppkey, round(distance, 6) AS distance, rank FROM n WHERE rank <= 3""")
def _(t):
    s = t("supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", F.col("s_acctbal").alias("balance"))
    c = t("customer").select(F.col("c_nationkey").alias("k"), "c_custkey", F.col("c_acctbal").alias("balance"))
    return joins.nearest(c, s, ["k"], ["balance"], {"balance": 1000.0}, "c_custkey", "s_suppkey", 3).select("c_custkey", "s_suppkey", r("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


# ---- aggregates


@query("agg_binned", """
SELECT f.measurement_category, p.step_index, count(*) AS points, count(DISTINCT p.metadata_id) AS files, round(avg(p.v_drain), 6) AS v_drain, round(max(abs(p.i_gate)) * 1e9, 6) AS most_i_gate_na
FROM baselines_measurements p JOIN baselines_metadata f ON f.id = p.metadata_id WHERE (p.v_drain IS NULL OR abs(p.v_drain) < 1e30) AND (p.i_gate IS NULL OR abs(p.i_gate) < 1e30) GROUP BY ALL""")
def _(t):
    f = t("baselines_metadata").select(F.col("id").alias("metadata_id"), "measurement_category")
    p = t("baselines_measurements").select("metadata_id", "step_index", "v_drain", "i_gate").filter("(v_drain IS NULL OR abs(v_drain) < 1e30) AND (i_gate IS NULL OR abs(i_gate) < 1e30)")
    return p.join(f, "metadata_id").groupBy("measurement_category", "step_index").agg(
        F.count("*").alias("points"), F.count_distinct("metadata_id").alias("files"), r(F.avg("v_drain")).alias("v_drain"), r(F.max(F.abs("i_gate")) * 1e9).alias("most_i_gate_na")
    )


@query("agg_mean_of_means", """
WITH m AS (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY ALL)
SELECT c_mktsegment, count(*) AS members, round(avg(m), 6) AS mean, round(avg(m) - coalesce(stddev_samp(m), 0), 6) AS low, round(avg(m) + coalesce(stddev_samp(m), 0), 6) AS high FROM m GROUP BY 1""")
def _(t):
    m = statistics.mean_of_means(t("customer"), ["c_mktsegment", "c_nationkey"], ["c_mktsegment"], "c_acctbal")
    return m.select("c_mktsegment", "members", *(r(c).alias(c) for c in ("mean", "low", "high")))


@query("agg_conditional", """
SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P') IS NULL AS no_partial,
  count(DISTINCT o_orderpriority) AS priorities, bool_or(o_totalprice > 300000) AS any_large, bool_and(o_totalprice > 1000) AS all_paid FROM orders GROUP BY 1 HAVING count(*) > 3""")
def _(t):
    status = F.col("o_orderstatus")
    return t("orders").groupBy("o_custkey").agg(
        F.count_if(status == "O").alias("open"), F.count_if(status == "F").alias("done"), F.sum(F.when(status == "P", F.col("o_totalprice"))).isNull().alias("no_partial"), F.count_distinct("o_orderpriority").alias("priorities"),
        F.bool_or(F.col("o_totalprice") > 300000).alias("any_large"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_paid"), F.count("*").alias("n"),
    ).filter("n > 3").drop("n")


@query("agg_percentiles", """
SELECT p_brand, round(quantile_cont(p_retailprice, 0.25), 5) AS q1, round(quantile_cont(p_retailprice, 0.5), 5) AS median, round(quantile_cont(p_retailprice, 0.9), 5) AS p90, round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 5) AS iqr FROM part GROUP BY 1""")
def _(t):
    q = lambda p: F.percentile("p_retailprice", F.lit(p))
    return t("part").groupBy("p_brand").agg(r(q(0.25), 5).alias("q1"), r(q(0.5), 5).alias("median"), r(q(0.9), 5).alias("p90"), r(q(0.75) - q(0.25), 5).alias("iqr"))


@query("agg_median_of_medians", """
WITH m AS (SELECT c_mktsegment, c_nationkey, quantile_cont(c_acctbal, 0.5) AS m FROM customer GROUP BY ALL) SELECT c_mktsegment, count(*) AS members, round(quantile_cont(m, 0.5), 5) AS median FROM m GROUP BY 1""")
def _(t):
    return statistics.median_of_medians(t("customer"), ["c_mktsegment", "c_nationkey"], ["c_mktsegment"], "c_acctbal").select("c_mktsegment", "members", r("median", 5).alias("median"))


@query("agg_string_lists", """
SELECT experiment, string_agg(DISTINCT measurement_category, ', ' ORDER BY measurement_category) AS categories, count(DISTINCT data_source) AS sources FROM baselines_metadata GROUP BY 1""")
def _(t):
    cats = F.array_sort(F.collect_set("measurement_category"))
    return t("baselines_metadata").groupBy("experiment").agg(F.when(F.size(cats) > 0, F.array_join(cats, ", ")).alias("categories"), F.count_distinct("data_source").alias("sources"))


@query("agg_first_last", """
SELECT metadata_id, first(time_val ORDER BY time_val IS NULL, time_val, point_index) AS first, last(time_val ORDER BY time_val IS NULL, time_val, point_index) AS last FROM baselines_measurements WHERE abs(time_val) < 1e30 GROUP BY 1""")
def _(t):
    return series.first_last(t("baselines_measurements").filter("abs(time_val) < 1e30"), ["metadata_id"], ["time_val", "point_index"], "time_val")


@query("agg_trapezoid", """
WITH s AS (SELECT user_id, value, epoch_us(ts) AS us, lag(value) OVER w AS v0, lag(epoch_us(ts)) OVER w AS us0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(sum((value + v0) / 2 * ((us - us0) / 1e6)), 0) AS integral, count(v0 + value) AS steps FROM s GROUP BY 1""")
def _(t):
    e = t("events").withColumn("seconds", F.timestamp_diff("MICROSECOND", F.lit("2000-01-01").cast("timestamp_ntz"), F.col("ts")) / 1e6)
    return series.trapezoid(e, ["user_id"], ["ts", "event_id"], "seconds", "value").select("user_id", r("integral", 0).alias("integral"), "steps")


@query("agg_half_peak_time", """
WITH p AS (SELECT user_id, abs(value) AS v, greatest(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS dt, max(abs(value)) OVER (PARTITION BY user_id) AS peak FROM events)
SELECT user_id, max(peak) AS peak, round(sum(dt / 1e6) FILTER (WHERE v >= 0.5 * peak), 3) AS duration FROM p GROUP BY 1""")
def _(t):
    e = t("events").withColumn("seconds", F.timestamp_diff("MICROSECOND", F.lit("2000-01-01").cast("timestamp_ntz"), F.col("ts")) / 1e6)
    return series.time_at_or_above(e, ["user_id"], ["ts", "event_id"], "seconds", "value").select("user_id", "peak", r("duration", 3).alias("duration"))


@query("agg_mode", """
SELECT s, m AS p_type, n FROM (SELECT p_brand AS s, p_type AS m, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS k FROM part GROUP BY 1, 2) WHERE k = 1""")
def _(t):
    return statistics.mode(t("part"), ["p_brand"], "p_type").withColumnRenamed("p_brand", "s")


@query("agg_robust_scale", """
SELECT p_brand, round(greatest(coalesce(nullif((quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25)) / 1.349, 0), nullif(stddev_samp(p_retailprice), 0), 1), 1e-6), 5) AS scale FROM part GROUP BY 1""")
def _(t):
    return statistics.robust_scale(t("part"), ["p_brand"], "p_retailprice").select("p_brand", r("scale", 5).alias("scale"))


@query("agg_robust_sigma", """
WITH m AS (SELECT user_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS med FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*) AS n, round(CASE WHEN count(*) < 5 THEN 0 WHEN quantile_cont(abs(value - med), 0.5) > 0 THEN 1.4826 * quantile_cont(abs(value - med), 0.5) ELSE stddev_pop(value) END, 5) AS sigma FROM m GROUP BY 1""")
def _(t):
    return statistics.robust_sigma(t("events"), ["user_id"], "value").select("user_id", "n", r("sigma", 5).alias("sigma"))


@query("agg_rates", """
SELECT user_id, count(*) AS n, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) * 1e5, 4) AS per_1e5_s FROM events GROUP BY 1""")
def _(t):
    span = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), r(F.try_divide(F.count("*").cast("double"), span) * 1e5, 4).alias("per_1e5_s"))


@query("agg_correlation", """
WITH d AS (SELECT l_returnflag AS g, l_quantity AS x, l_discount AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL),
k AS (SELECT g, x, y, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM d)
SELECT g, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k GROUP BY 1""")
def _(t):
    c = statistics.correlations(t("lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")), ["g"], "x", "y")
    return c.select("g", "n", r("pearson").alias("pearson"), r("spearman").alias("spearman"))


@query("agg_pivot", """
SELECT o_custkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS "O", max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS "F", max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def _(t):
    return t("orders").groupBy("o_custkey").pivot("o_orderstatus", ["O", "F", "P"]).agg(F.max("o_totalprice"))


@query("agg_fingerprint", """
SELECT coalesce(data_source, 'baselines') AS source, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', coalesce(csv_path, '~'), coalesce(file_hash, '~'), coalesce(CAST(num_points AS VARCHAR), '~'))), 1, 12) AS HUGEINT)) AS VARCHAR) AS digest FROM baselines_metadata GROUP BY 1""")
def _(t):
    f = t("baselines_metadata").withColumn("source", F.coalesce("data_source", F.lit("baselines")))
    return statistics.fingerprint(f, ["source"], ["csv_path", "file_hash", "num_points"])


@query("agg_snapshot_diff", """
WITH f AS (SELECT measurement_category, CAST(sum(CAST('0x' || substr(md5(coalesce(csv_path, '~')), 1, 12) AS HUGEINT)) FILTER (WHERE ingest_batch < 9) AS VARCHAR) AS a, count(*) FILTER (WHERE ingest_batch < 9) AS n_old, CAST(sum(CAST('0x' || substr(md5(coalesce(csv_path, '~')), 1, 12) AS HUGEINT)) AS VARCHAR) AS b, count(*) AS n_new FROM baselines_metadata WHERE measurement_category IS NOT NULL GROUP BY 1)
SELECT measurement_category, nullif(n_old, 0) AS n_old, n_new, CASE WHEN n_old = 0 THEN 'added' ELSE 'changed' END AS change FROM f WHERE n_old = 0 OR a <> b""")
def _(t):
    f = t("baselines_metadata").filter("measurement_category IS NOT NULL")
    mark = lambda d: statistics.fingerprint(d, ["measurement_category"], ["csv_path"])
    return statistics.snapshot_diff(mark(f.filter("ingest_batch < 9")), mark(f), ["measurement_category"])


@query("agg_weighted_quantile", """
WITH w AS (SELECT l_returnflag, l_quantity, sum(l_extendedprice) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM w)
SELECT l_returnflag, q, min(l_quantity) AS l_quantity FROM c, (SELECT unnest([0.1, 0.5, 0.9]) AS q) WHERE run >= q * total GROUP BY ALL""")
def _(t):
    return statistics.weighted_quantile(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", [0.1, 0.5, 0.9])


# ---- windows


@query("win_lags", """
SELECT event_id, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id)""")
def _(t):
    w = series.ordered(["user_id"], ["ts", "event_id"])
    return t("events").select("event_id", F.lag("value", 1).over(w).alias("v1"), F.lag("value", 2).over(w).alias("v2"), F.lag("event_type").over(w).alias("before"))


@query("win_nested_ranks", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size > 25 ORDER BY p_retailprice DESC, p_partkey) AS inner_rank FROM part)
SELECT p_partkey, inner_rank, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, inner_rank, p_partkey) AS outer_rank, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS size_rank FROM a""")
def _(t):
    big = F.col("p_size") > 25
    a = t("part").withColumn("inner_rank", F.row_number().over(Window.partitionBy("p_brand", big).orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long"))
    outer = Window.partitionBy("p_brand").orderBy(F.when(big, 0).otherwise(1), "inner_rank", "p_partkey")
    return a.select("p_partkey", "inner_rank", F.row_number().over(outer).cast("long").alias("outer_rank"), F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")).cast("long").alias("size_rank"))


@query("win_filtered_rank", """
SELECT c.c_custkey, r.n AS safe_rank, round(100.0 * r.n / count(*) OVER (PARTITION BY c.c_mktsegment), 6) AS share, count(*) FILTER (WHERE c.c_acctbal > 0) OVER (PARTITION BY c.c_mktsegment) AS solvent
FROM customer c LEFT JOIN (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WHERE c_acctbal > 0) r USING (c_custkey)""")
def _(t):
    good = F.col("c_acctbal") > 0
    w = Window.partitionBy("c_mktsegment", good).orderBy(F.desc("c_acctbal"), "c_custkey")
    pool = Window.partitionBy("c_mktsegment")
    rank = F.when(good, F.row_number().over(w).cast("long"))
    c = t("customer").withColumn("safe_rank", rank)
    return c.select("c_custkey", "safe_rank", r(100.0 * F.col("safe_rank") / F.count("*").over(pool)).alias("share"), F.count_if(good).over(pool).alias("solvent"))


@query("win_keeper", """
SELECT id, min(id) OVER (PARTITION BY lower(regexp_replace(coalesce(csv_path, ''), '.*[/\\\\]', ''))) AS keeper FROM baselines_metadata""")
def _(t):
    return t("baselines_metadata").select("id", F.min("id").over(Window.partitionBy(F.lower(F.regexp_replace(F.coalesce("csv_path", F.lit("")), r"(?s).*[/\\]", "")))).alias("keeper"))


@query("win_running_total", """
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'refund' OR event_id % 97 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, row_number() OVER w AS ordinal, CASE WHEN bool_or(v IS NULL) OVER w THEN NULL ELSE round(sum(v) OVER w, 4) END AS total FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t):
    e = t("events").withColumn("v", F.when((F.col("event_type") == "refund") | (F.col("event_id") % 97 == 0), None).otherwise(F.col("value")))
    return series.running_total(e, ["user_id"], ["ts", "event_id"], "v").select("event_id", "ordinal", r("total", 4).alias("total"))


@query("win_islands", """
WITH a AS (SELECT DISTINCT l_partkey, l_orderkey AS k FROM lineitem), b AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY l_partkey ORDER BY k) <= 500 THEN 0 ELSE 1 END AS new FROM a),
c AS (SELECT *, sum(new) OVER (PARTITION BY l_partkey ORDER BY k) AS island FROM b) SELECT l_partkey, CAST(island AS BIGINT) AS island, min(k) AS first, max(k) AS last, count(*) AS n FROM c GROUP BY ALL""")
def _(t):
    return series.clusters(t("lineitem").select("l_partkey", F.col("l_orderkey").alias("k")).distinct(), ["l_partkey"], "k", 500)


@query("win_rolling_step", """
WITH w AS (SELECT event_id, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a FROM events)
SELECT event_id, round(b, 5) AS before, round(a, 5) AS after, round(coalesce(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE greatest(a - b, 0) END, 0), 5) AS step FROM w""")
def _(t):
    d = series.rolling_step(t("events"), ["user_id"], ["ts", "event_id"], "value", 3)
    return d.select("event_id", *(r(c, 5).alias(c) for c in ("before", "after", "step")))


@query("win_edges", """
WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS j FROM events)
SELECT user_id, round(quantile_cont(value, 0.5) FILTER (WHERE i <= 5), 5) AS head, round(quantile_cont(value, 0.5) FILTER (WHERE j <= 5), 5) AS tail FROM n GROUP BY 1""")
def _(t):
    return series.edge_medians(t("events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", r("head", 5).alias("head"), r("tail", 5).alias("tail"))


@query("win_first_crossing", """
SELECT metadata_id, min(CASE WHEN i_drain >= 1e-3 AND i_drain < 1e30 THEN point_index END) AS crossing FROM baselines_measurements GROUP BY 1""")
def _(t):
    return series.first_crossing(t("baselines_measurements"), ["metadata_id"], "point_index", (F.col("i_drain") >= 1e-3) & (F.col("i_drain") < 1e30))


@query("win_argmax", """
SELECT metadata_id, point_index, v_drain FROM (SELECT metadata_id, point_index, v_drain, row_number() OVER (PARTITION BY metadata_id ORDER BY v_drain DESC, point_index) AS n FROM baselines_measurements WHERE abs(v_drain) < 1e30) WHERE n = 1""")
def _(t):
    return series.argmax(t("baselines_measurements").filter("abs(v_drain) < 1e30"), ["metadata_id"], "v_drain", "point_index")


# ---- order, distinct, sets


@query("top_per_group", """
SELECT c_mktsegment, c_custkey, c_acctbal, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 10""")
def _(t):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t("customer").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10").select("c_mktsegment", "c_custkey", "c_acctbal", "rank")


@query("top_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("top_priority_order", """
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def _(t):
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return sinks.keep_first(t("orders"), ["o_custkey"], [rank, F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("set_padded_union", """
SELECT 'customer' AS kind, c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS price FROM customer UNION ALL SELECT 'part', p_partkey, NULL, p_retailprice FROM part""")
def _(t):
    c = t("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    p = t("part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    return c.unionByName(p, allowMissingColumns=True)


@query("set_union_distinct", "SELECT device_id AS name FROM baselines_metadata UNION SELECT part_number FROM device_library UNION SELECT part_number FROM documents")
def _(t):
    return t("baselines_metadata").select(F.col("device_id").alias("name")).union(t("device_library").select("part_number")).union(t("documents").select("part_number")).distinct()


@query("set_values", """
SELECT v.label, count(*) AS lines FROM lineitem JOIN (VALUES ('R', 'returned'), ('A', 'accepted'), ('N', 'none')) v(flag, label) ON l_returnflag = v.flag GROUP BY 1""")
def _(t):
    items = t("lineitem")
    v = items.sparkSession.createDataFrame([("R", "returned"), ("A", "accepted"), ("N", "none")], "l_returnflag string, label string")
    return items.join(F.broadcast(v), "l_returnflag").groupBy("label").agg(F.count("*").alias("lines"))


# ---- tables that change


@query("src_hash_skip", """
SELECT lower(trim(file_hash)) AS hash, min(id) AS id FROM baselines_metadata WHERE ingest_batch = 9 AND file_hash IS NOT NULL AND lower(trim(file_hash)) NOT IN (SELECT lower(trim(file_hash)) FROM baselines_metadata WHERE ingest_batch < 9 AND file_hash IS NOT NULL) GROUP BY 1""")
def _(t):
    f = t("baselines_metadata").withColumn("hash", F.lower(F.trim("file_hash")))
    return listing.new_files(f.filter("ingest_batch = 9"), f.filter("ingest_batch < 9 AND hash IS NOT NULL"), "hash")


@query("src_group_hash", """
SELECT sample_group, md5(string_agg(file_hash, '' ORDER BY file_hash)) AS group_hash FROM baselines_metadata WHERE file_hash IS NOT NULL GROUP BY 1""")
def _(t):
    return listing.group_hash(t("baselines_metadata"), ["sample_group"], "file_hash")


@query("src_search", """
SELECT id FROM baselines_metadata WHERE contains(lower(csv_path), 'ageing') AND contains(lower(csv_path), '_post')""")
def _(t):
    return listing.search(t("baselines_metadata"), "csv_path", "Ageing _post").select("id")


@query("src_upsert", """
SELECT c_custkey AS id, coalesce(s_acctbal, c_acctbal) AS balance FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""")
def _(t):
    old = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return sinks.upsert(old, t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), ["id"])


@query("src_insert_only", """
SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey + 1400, s_acctbal FROM supplier WHERE s_suppkey + 1400 NOT IN (SELECT c_custkey FROM customer)""")
def _(t):
    old = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return sinks.upsert(old, t("supplier").select((F.col("s_suppkey") + 1400).alias("id"), F.col("s_acctbal").alias("balance")), ["id"], update=False)


@query("src_update_from", """
SELECT f.id, coalesce(c.facility, 'none') AS place FROM baselines_metadata f LEFT JOIN irradiation_campaigns c ON f.irrad_campaign_id = c.id""")
def _(t):
    f = t("baselines_metadata").select("id", "irrad_campaign_id", F.lit("none").alias("place"))
    return sinks.update_from(f, t("irradiation_campaigns").select(F.col("id").alias("irrad_campaign_id"), F.col("facility").alias("place")), ["irrad_campaign_id"], ["place"]).select("id", "place")


@query("src_delete_repeats", """
SELECT min(id) AS id, metadata_id, step_index, point_index FROM baselines_measurements GROUP BY metadata_id, step_index, point_index""")
def _(t):
    p = t("baselines_measurements").select("id", "metadata_id", "step_index", "point_index")
    return p.groupBy("metadata_id", "step_index", "point_index").agg(F.min("id").alias("id"))


@query("src_export", """
SELECT experiment, array_to_string(list_sort(list(DISTINCT measurement_category) FILTER (WHERE measurement_category IS NOT NULL)), '; ') AS categories, coalesce(CAST(min(measured_on) AS VARCHAR), '') AS first FROM baselines_metadata WHERE experiment IS NOT NULL AND measurement_category IS NOT NULL GROUP BY 1""")
def _(t):
    f = t("baselines_metadata").filter("experiment IS NOT NULL AND measurement_category IS NOT NULL")
    return sinks.flattened(f.groupBy("experiment").agg(F.array_sort(F.collect_set("measurement_category")).alias("categories"), F.min("measured_on").alias("first")))


@query("src_gone", """
SELECT id FROM baselines_metadata WHERE csv_path IS NOT NULL AND csv_path NOT IN (SELECT csv_path FROM baselines_metadata WHERE ingest_batch >= 5 AND csv_path IS NOT NULL)""")
def _(t):
    f = t("baselines_metadata")
    return listing.gone(f, f.filter("ingest_batch >= 5 AND csv_path IS NOT NULL"), "csv_path").select("id")


@query("src_channel_groups", """
SELECT regexp_replace(filename, '(?i)_[0-9]+([.][^.]*)$', '\\1') AS base, count(*) AS channels FROM baselines_metadata WHERE filename IS NOT NULL GROUP BY 1""")
def _(t):
    f = t("baselines_metadata").filter("filename IS NOT NULL").select(F.regexp_replace("filename", r"_([0-9]+)(?=\.[^.]*$)", "_ch$1").alias("path"))
    return listing.channel_groups(f, "path").select("base", "channels")


QUERIES, SQL = query.queries, query.sql
