"""Registry of the panel queries: each name has a Spark query and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadflow.functions.distance import great_circle_km
from dyadflow.functions.keys import compose_code, level_sq_log, norm_code, safe_ratio, to_number
from dyadflow.operators import fold, models, panel, quality, route, space
from dyadflow.plans import standins as s
from dyadflow.sources.tables import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def flows(spark, sf):
    """The flows of all pairs, written: they are few, and their readers would join and group all records again each time."""
    return written(route.aggregate_od(s.records(spark, sf)))


def dense(spark, sf):
    return panel.attach_flows(panel.build_spine(s.units(spark, sf)), flows(spark, sf))


def r(name: str, digits: int = 4):
    return F.round(name, digits).alias(name)


@query(f"""WITH {s.RECORDS}, {s.UNITS}, {s.FLOWS}, {s.PANEL}
SELECT orig, dest, migrants, n AS migrants_unweighted, n > 0 AS flow_observed, CASE WHEN n > 0 THEN 'observed_positive'
  WHEN orig IN (SELECT orig FROM panel WHERE n > 0) AND dest IN (SELECT dest FROM panel WHERE n > 0) THEN 'sampling_zero_plausible' ELSE 'structural_zero_likely' END AS zero_class FROM panel""")
def panel_classified_zeros(spark, sf):
    seen = panel.assert_unique(flows(spark, sf), "orig", "dest")
    full = panel.attach_flows(panel.build_spine(s.units(spark, sf)), seen)
    return panel.classify_zeros(full, seen).select("orig", "dest", "migrants", "migrants_unweighted", "flow_observed", "zero_class")


@query(f"""WITH {s.RECORDS}, {s.UNITS}, {s.FLOWS}, {s.PANEL}
SELECT count(*) AS n_rows, count(DISTINCT orig) AS n_orig, count(*) FILTER (orig = dest) AS n_diagonal, count(*) FILTER (migrants < 0) AS n_negative, count(*) = count(DISTINCT orig) * (count(DISTINCT orig) - 1) AS complete FROM panel""")
def panel_complete_product(spark, sf):
    return panel.complete_product(panel.assert_unique(dense(spark, sf), "orig", "dest"))


BUCKET = "CASE WHEN age < 5 THEN 'under_age' WHEN sentinel = 9 THEN 'not_specified' WHEN sentinel = 8 THEN 'foreign' WHEN sentinel = 7 THEN 'non_migrant' ELSE 'domestic' END"


def routed(spark, sf):
    rules = [("under_age", F.col("age") < 5), ("not_specified", F.col("sentinel") == 9), ("foreign", F.col("sentinel") == 8), ("non_migrant", F.col("sentinel") == 7)]
    return s.records(spark, sf).withColumn("bucket", route.classify(rules, "domestic"))


@query(f"WITH {s.RECORDS}, b AS (SELECT *, {BUCKET} AS bucket FROM records) SELECT bucket, count(*) AS records, sum(w) AS weighted, round(100.0 * count(*) / (SELECT count(*) FROM b), 4) AS pct FROM b GROUP BY 1")
def origin_buckets(spark, sf):
    return route.reconcile(routed(spark, sf)).withColumn("pct", F.round("pct", 4))


@query(f"""WITH {s.RECORDS}, b AS (SELECT *, {BUCKET} AS bucket FROM records)
SELECT orig, dest, sum(w) AS migrants, count(*) AS migrants_unweighted FROM (SELECT orig, dest, w FROM b WHERE bucket = 'domestic' UNION ALL SELECT dest, dest, w FROM b WHERE bucket = 'non_migrant') GROUP BY 1, 2""")
def od_with_stayers(spark, sf):
    rows = routed(spark, sf)
    stayed = rows.where("bucket = 'non_migrant'").groupBy("dest").agg(F.sum("w").alias("migrants"), F.count(F.lit(1)).alias("migrants_unweighted"))
    return route.fold_diagonal(route.aggregate_od(rows.where("bucket = 'domestic'")), stayed)


@query(f"""WITH {s.RECORDS}, b AS (SELECT *, {BUCKET} AS bucket FROM records)
SELECT bucket, dest, sum(w) AS migrants, count(*) AS migrants_unweighted FROM b WHERE bucket IN ('foreign', 'not_specified') GROUP BY 1, 2""")
def excluded_flows(spark, sf):
    return route.select_excluded(routed(spark, sf), ["foreign", "not_specified"])


@query(f"""WITH {s.RECORDS}, {s.UNITS}, {s.CROSSWALK}
SELECT coalesce(a.parent, orig) AS orig, coalesce(b.parent, dest) AS dest, sum(w) AS migrants, count(*) AS migrants_unweighted
FROM records LEFT JOIN xw a ON orig = a.child LEFT JOIN xw b ON dest = b.child GROUP BY 1, 2""")
def flows_folded_by_crosswalk(spark, sf):
    xwalk = fold.validate_crosswalk(s.crosswalk(spark, sf))
    rows = s.records(spark, sf)
    for side in ("orig", "dest"):
        rows = fold.apply_crosswalk(rows, side, xwalk)
    return route.aggregate_od(rows)


@query(f"""WITH {s.UNITS}, {s.CROSSWALK}, {s.VINTAGES}, v AS (SELECT coalesce(v1.code, v2.code) AS code, pop_1, pop_2, income_2 FROM v1 FULL JOIN v2 ON v1.code = v2.code)
SELECT coalesce(parent, code) AS code, round(sum(pop_1), 2) AS pop_1, CAST(sum(pop_2) AS BIGINT) AS pop_2,
  round(CASE WHEN bool_or(income_2 IS NOT NULL AND pop_1 IS NULL) THEN avg(income_2) ELSE sum(income_2 * pop_1) / sum(pop_1) FILTER (income_2 IS NOT NULL) END, 4) AS income_2, count(*) > 1 AS folded
FROM v LEFT JOIN xw ON code = child GROUP BY 1""")
def unit_tables_folded(spark, sf):
    a, b = s.vintages(spark, sf)
    v = fold.apply_crosswalk(fold.outer_with_indicator(a, b, "code"), "code", s.crosswalk(spark, sf))
    return panel.audited_left_join(fold.fold_extensive(v, "code", "pop_1", "pop_2"), fold.fold_intensive(v, "code", "income_2", "pop_1"), ["code"]).select("code", r("pop_1", 2), "pop_2", r("income_2"), "folded")


@query(f"WITH {s.VINTAGES} SELECT CASE WHEN v1.code IS NULL THEN 'right_only' WHEN v2.code IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n, round(sum(pop_1), 2) AS pop_1, CAST(sum(pop_2) AS BIGINT) AS pop_2 FROM v1 FULL JOIN v2 ON v1.code = v2.code GROUP BY 1")
def vintages_joined(spark, sf):
    both = fold.outer_with_indicator(*s.vintages(spark, sf), "code")
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pop_1"), 2).alias("pop_1"), F.sum("pop_2").alias("pop_2"))


@query(f"WITH {s.VINTAGES} SELECT coalesce(v1.code, v2.code) AS code, round(CASE WHEN (income_1 IS NULL OR income_1 <= 4000) AND income_2 > 0 THEN income_2 WHEN income_1 <= 4000 THEN 0 ELSE income_1 END, 4) AS income, CASE WHEN (income_1 IS NULL OR income_1 <= 4000) AND income_2 > 0 THEN 'income_fallback' WHEN income_1 IS NULL THEN 'missing' ELSE 'primary' END AS income_source FROM v1 FULL JOIN v2 ON v1.code = v2.code")
def income_with_fallback(spark, sf):
    both = fold.outer_with_indicator(*s.vintages(spark, sf), "code")
    return both.select("code", *fold.source_fallback(F.when(F.col("income_1") > 4000, F.col("income_1")).when(F.col("income_1").isNotNull(), F.lit(0.0)), F.col("income_2"), "income")).withColumn("income", F.round("income", 4))


@query(f"WITH {s.RECORDS}, {s.FLOWS}, known AS (SELECT DISTINCT {s.Z.format('s_suppkey')} AS code FROM supplier) SELECT side, code, count(*) AS cells, sum(migrants) AS weight FROM (SELECT 'orig' AS side, orig AS code, migrants FROM flows UNION ALL SELECT 'dest', dest, migrants FROM flows) WHERE code NOT IN (SELECT code FROM known) GROUP BY 1, 2")
def orphan_report(spark, sf):
    return panel.orphans(flows(spark, sf), s.table(spark, sf, "supplier").select(s.zone("s_suppkey").alias("code")))


@query(f"WITH {s.UNITS}, known AS (SELECT DISTINCT {s.Z.format('s_suppkey')} AS code FROM supplier) SELECT code, 'orphan_in_data' AS problem FROM units WHERE code NOT IN (SELECT code FROM known) UNION ALL SELECT code, 'absent_from_data' FROM known WHERE code NOT IN (SELECT code FROM units)")
def code_audit(spark, sf):
    return panel.audit_codes(s.units(spark, sf), s.table(spark, sf, "supplier").select(s.zone("s_suppkey").alias("code")))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 34 = 0 THEN NULL ELSE lpad(CAST(o_custkey % 34 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 570 AS VARCHAR), 3, '0') END AS code,
  lpad(CAST(o_orderkey % 570 AS VARCHAR), 3, '0') AS unit, CASE WHEN o_custkey % 34 = 0 THEN NULL ELSE CAST(o_custkey % 34 AS DOUBLE) END AS number FROM orders""")
def composed_codes(spark, sf):
    state = F.when(F.col("o_custkey") % 34 == 0, "nan").otherwise(F.concat(F.lit(" "), (F.col("o_custkey") % 34).cast("string"), F.lit(".0 ")))
    unit = (F.col("o_orderkey") % 570).cast("string")
    return s.table(spark, sf, "orders").select("o_orderkey", compose_code(state, unit).alias("code"), norm_code(unit, 3).alias("unit"), F.nanvl(to_number(state), F.lit(None).cast("double")).alias("number"))


@query(f"""WITH c AS (SELECT {s.Z.format('l_orderkey')} AS code, l_linenumber AS est, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)
SELECT code, {', '.join(f"max(CASE WHEN est = {i} THEN v END) AS {n}" for i, n in enumerate(('value', 'se', 'low', 'high', 'cv', 'e6', 'e7'), 1))} FROM c GROUP BY 1""")
def estimates_pivoted(spark, sf):
    cells = s.table(spark, sf, "lineitem").groupBy(s.zone("l_orderkey").alias("code"), F.col("l_linenumber").alias("est")).agg(F.max("l_extendedprice").alias("v"))
    return fold.pivot_estimates(cells, "code", "est", "v", dict(enumerate(("value", "se", "low", "high", "cv", "e6", "e7"), 1)))


@query(f"""WITH m AS (SELECT {s.Z.format('o_custkey')} AS code, month(o_orderdate) AS month, CAST(sum(floor(o_totalprice)) AS BIGINT) AS v FROM orders GROUP BY 1, 2)
SELECT code, round(avg(v), 6) AS mean, CAST(sum(v) AS BIGINT) AS total, min(v) AS low, max(v) AS high, count(v) AS n_months, count(v) = 12 AS complete FROM m GROUP BY 1""")
def climate_from_months(spark, sf):
    months = s.table(spark, sf, "orders").groupBy(s.zone("o_custkey").alias("code"), F.month("o_orderdate").alias("month")).agg(F.sum(F.floor("o_totalprice")).alias("v"))
    return fold.annual_from_months(months, "code", "month", "v").select("code", r("mean", 6), "total", "low", "high", "n_months", "complete")


@query(f"SELECT {s.Z.format('p_partkey')} AS code, count(*) FILTER (p_size BETWEEN 15 AND 29) AS band, count(*) AS total, round(count(*) FILTER (p_size BETWEEN 15 AND 29) / count(*), 6) AS share FROM part GROUP BY 1")
def youth_share(spark, sf):
    people = s.table(spark, sf, "part").select(s.zone("p_partkey").alias("code"), "p_size", F.lit(1).cast("long").alias("n"))
    return fold.band_share(people, "code", "p_size", "n", 15, 29).withColumn("share", F.round("share", 6))


@query(f"WITH {s.VINTAGES} SELECT code, round(income_1, 4) AS income_1, round(income_1 * income_1, 2) AS income_1_sq, round(CASE WHEN income_1 > 0 THEN ln(income_1) END, 6) AS log_income_1, round(CASE WHEN income_1 > 0 THEN ln(income_1) ** 2 END, 6) AS log_income_1_sq, round(CASE WHEN pop_1 > 0 THEN income_1 / pop_1 END, 6) AS ratio FROM v1")
def income_terms(spark, sf):
    a, _ = s.vintages(spark, sf)
    return a.select("code", *level_sq_log("income_1"), safe_ratio(F.col("income_1"), F.col("pop_1")).alias("ratio")).select("code", r("income_1"), r("income_1_sq", 2), r("log_income_1", 6), r("log_income_1_sq", 6), r("ratio", 6))


@query(f"WITH {s.UNITS}, {s.POINTS}, {s.DISTANCES} SELECT orig, dest, round(km, 4) AS km FROM dist")
def pair_distances(spark, sf):
    return s.distances(spark, sf).select("orig", "dest", r("km"))


@query(f"""WITH {s.RECORDS}, {s.UNITS}, {s.FLOWS}, {s.PANEL}, {s.VINTAGES}, {s.POINTS}, {s.DISTANCES}
SELECT p.orig, p.dest, migrants, round(a.pop_1, 2) AS pop_1_orig, round(b.pop_1, 2) AS pop_1_dest, round(km, 4) AS km
FROM panel p LEFT JOIN v1 a ON a.code = p.orig LEFT JOIN v1 b ON b.code = p.dest LEFT JOIN dist d ON d.orig = p.orig AND d.dest = p.dest""")
def panel_with_covariates(spark, sf):
    a, _ = s.vintages(spark, sf)
    units = s.points(spark, sf).join(a.select("code", "pop_1"), "code", "left")
    full = panel.attach_both_roles(dense(spark, sf), units)
    km = great_circle_km(*map(F.col, ("lat_orig", "lon_orig", "lat_dest", "lon_dest")))
    return full.select("orig", "dest", "migrants", r("pop_1_orig", 2), r("pop_1_dest", 2), F.round(km, 4).alias("km"))


@query(f"""WITH {s.VINTAGES}, b AS (SELECT v1.code, income_1 AS a, income_2 AS b FROM v1 JOIN v2 ON v1.code = v2.code WHERE income_1 > 0 AND income_2 > 0),
k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM b)
SELECT count(*) AS n, round(corr(ln(a), ln(b)), 6) AS r_log, round(corr(a, b), 6) AS r_level, round(corr(ra, rb), 6) AS spearman, round(median(a / b), 6) AS median_ratio FROM k""")
def income_sources_agree(spark, sf):
    a, b = s.vintages(spark, sf)
    return quality.source_agreement(a.join(b, "code"), "code", "income_1", "income_2").select("n", r("r_log", 6), r("r_level", 6), r("spearman", 6), r("median_ratio", 6))


@query(f"WITH {s.VINTAGES}, v AS (SELECT coalesce(v1.code, v2.code) AS code, pop_1, income_1 FROM v1 FULL JOIN v2 ON v1.code = v2.code) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, round(100.0 * (count(*) - count({c})) / count(*), 4) AS pct FROM v" for c in ("code", "pop_1", "income_1")))
def missing_values(spark, sf):
    return quality.missingness(fold.outer_with_indicator(*s.vintages(spark, sf), "code").select("code", "pop_1", "income_1")).withColumn("pct", F.round("pct", 4))


@query("SELECT count(*) AS n, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(median(o_totalprice), 4) AS mid, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, max(o_totalprice) AS high, round(sum(o_totalprice), 1) AS total FROM orders")
def value_summary(spark, sf):
    return quality.summary(s.table(spark, sf, "orders"), "o_totalprice").select("n", "low", r("p25"), r("mid"), r("mean"), r("p75"), "high", r("total", 1))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 4) AS pct FROM events GROUP BY 1")
def class_counts(spark, sf):
    return quality.value_counts(s.table(spark, sf, "events"), "event_type").withColumn("pct", F.round("pct", 4))


@query("SELECT CASE WHEN p_retailprice < 1000 THEN 'below' WHEN p_retailprice < 1500 THEN 'between' WHEN p_retailprice >= 1500 THEN 'above' ELSE 'missing' END AS band, count(*) AS n FROM part GROUP BY 1")
def price_bands(spark, sf):
    return quality.bands(s.table(spark, sf, "part"), "p_retailprice", 1000, 1500)


@query(f"""WITH {s.CELLS} SELECT zone, round(sum(CASE WHEN value IS NOT NULL THEN value * weight END) / sum(CASE WHEN value IS NOT NULL THEN weight END), 6) AS mean, round(avg(value), 6) AS plain_mean,
  sum(CASE WHEN value IS NOT NULL THEN weight END) AS weight_sum, count(value) AS n_cells,
  CASE WHEN sum(CASE WHEN value IS NOT NULL THEN weight END) > 0 THEN 'population_weighted' WHEN count(value) > 0 THEN 'unweighted_fallback' ELSE 'no_valid_cells' END AS method FROM cells GROUP BY 1""")
def zonal_means(spark, sf):
    return space.zonal_mean(s.cells(spark, sf), "zone").select("zone", r("mean", 6), r("plain_mean", 6), "weight_sum", "n_cells", "method")


@query(f"WITH {s.CELLS} SELECT zone, round(sum(weight * (col + 0.5)) / sum(weight), 6) AS center_col, round(sum(weight * (row_ + 0.5)) / sum(weight), 6) AS center_row FROM cells GROUP BY 1")
def zonal_centroids(spark, sf):
    return space.weighted_centroid(s.cells(spark, sf), "zone").select("zone", r("center_col", 6), r("center_row", 6))


@query(f"WITH {s.CELLS} SELECT col // 4 AS col, row_ // 4 AS row, sum(weight) AS weight FROM cells GROUP BY 1, 2")
def coarse_grid(spark, sf):
    return space.regrid_sum(s.cells(spark, sf), 4)


KNN = "knn AS (SELECT orig, dest, 0.2::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY orig ORDER BY round(km, 6), dest) AS i FROM dist) WHERE i <= 5)"


def neighbours(spark, sf):
    return space.knn_weights(s.distances(spark, sf).withColumn("km", F.round("km", 6)), 5, "km")


@query(f"WITH {s.UNITS}, {s.POINTS}, {s.DISTANCES}, {KNN} SELECT orig, dest, weight FROM knn")
def nearest_neighbours(spark, sf):
    return neighbours(spark, sf)


@query(f"WITH {s.UNITS}, {s.POINTS}, {s.DISTANCES}, {KNN}, {s.VINTAGES} SELECT orig AS code, round(sum(weight * income_2), 4) AS lag FROM knn JOIN v2 ON dest = code GROUP BY 1")
def spatial_lag(spark, sf):
    return space.spatial_lag(neighbours(spark, sf), s.vintages(spark, sf)[1], "code", "income_2").select("code", r("lag"))


@query(f"""WITH {s.UNITS}, {s.POINTS}, {s.DISTANCES}, {KNN}, {s.VINTAGES}, z AS (SELECT code, income_2 - (SELECT avg(income_2) FROM v2) AS z FROM v2)
SELECT (SELECT count(*) FROM z) AS n, round((SELECT count(*) FROM z) / sum(weight) * sum(weight * a.z * b.z) / (SELECT sum(z * z) FROM z), 6) AS moran FROM knn JOIN z a ON a.code = orig JOIN z b ON b.code = dest""")
def morans_i(spark, sf):
    return space.morans_i(neighbours(spark, sf), s.vintages(spark, sf)[1], "code", "income_2").select("n", r("moran", 6))


@query(f"""WITH {s.UNITS}, {s.POINTS}, {s.DISTANCES}, {s.VINTAGES}, v AS (SELECT code, CASE WHEN CAST(code AS INT) % 7 <> 0 THEN income_2 END AS x FROM v2),
near AS (SELECT orig, x, km, row_number() OVER (PARTITION BY orig ORDER BY round(km, 6), dest) AS i FROM dist JOIN v ON dest = code WHERE x IS NOT NULL),
made AS (SELECT orig, sum(x / (round(km, 6) * round(km, 6))) / sum(1 / (round(km, 6) * round(km, 6))) AS x FROM near WHERE i <= 8 GROUP BY 1)
SELECT code, round(coalesce(v.x, made.x), 4) AS income, CASE WHEN v.x IS NOT NULL THEN 'given' ELSE 'idw_knn_fill' END AS method FROM v LEFT JOIN made ON orig = code""")
def filled_from_neighbours(spark, sf):
    lacking = s.vintages(spark, sf)[1].select("code", F.when(F.col("code").cast("int") % 7 != 0, F.col("income_2")).alias("income"))
    return space.idw_fill(lacking, s.distances(spark, sf).withColumn("km", F.round("km", 6)), "code", "income", "km").select("code", r("income"), "method")


SPLIT = """cuts AS (SELECT quantile_cont(income_2, 1 / 3::DOUBLE) AS a, quantile_cont(income_2, 2 / 3::DOUBLE) AS b FROM v2),
st AS (SELECT code, (income_2 > a)::INT + (income_2 > b)::INT AS stratum FROM v2, cuts),
sp AS (SELECT code, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY CAST(code AS INT) * 7919 % 1009, code) <= ceil(0.2 * count(*) OVER (PARTITION BY stratum)) THEN 'test' ELSE 'train' END AS split FROM st)"""


def splits(spark, sf):
    return models.unit_split(s.vintages(spark, sf)[1], "code", "income_2", F.col("code").cast("int") * 7919 % 1009)


@query(f"WITH {s.VINTAGES}, {SPLIT} SELECT code, stratum, split FROM sp")
def unit_splits(spark, sf):
    return splits(spark, sf)


@query(f"WITH {s.RECORDS}, {s.FLOWS}, {s.VINTAGES}, {SPLIT} SELECT CASE WHEN a.split = b.split THEN a.split ELSE 'inference' END AS split, count(*) AS dyads, sum(migrants) AS migrants FROM flows LEFT JOIN sp a ON a.code = orig LEFT JOIN sp b ON b.code = dest GROUP BY 1")
def dyad_splits(spark, sf):
    return models.dyad_split(flows(spark, sf), splits(spark, sf), "code").groupBy("split").agg(F.count(F.lit(1)).alias("dyads"), F.sum("migrants").alias("migrants"))


@query(f"WITH {s.VINTAGES}, {SPLIT}, f AS (SELECT v2.*, split FROM v2 JOIN sp USING (code)) SELECT code, round((pop_2 - (SELECT avg(pop_2) FROM f WHERE split = 'train')) / (SELECT stddev_pop(pop_2) FROM f WHERE split = 'train'), 5) AS pop_2, split FROM f")
def standardized_features(spark, sf):
    rows = s.vintages(spark, sf)[1].join(splits(spark, sf), "code").select("code", F.col("pop_2").cast("double").alias("pop_2"), "split")
    return models.standardize(rows, ["pop_2"], F.col("split") == "train").select("code", r("pop_2", 5), "split")


@query(f"""WITH {s.RECORDS}, {s.FLOWS}, f AS (SELECT CASE WHEN orig < '00100' THEN 'low' ELSE 'high' END AS half, migrants AS y, 26.0::DOUBLE * n AS p FROM flows)
SELECT half, round(2 * sum(least(y, p)) / (sum(y) + sum(p)), 6) AS cpc, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(sqrt(avg((ln(1 + y) - ln(1 + p)) ** 2)), 5) AS rmse_log,
  round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 5) AS r2, round(1 - sum((ln(1 + y) - ln(1 + p)) ** 2) / (var_pop(ln(1 + y)) * count(*)), 5) AS r2_log, round(avg(p - y * ln(p + 1e-8)), 3) AS poisson_nll FROM f GROUP BY 1""")
def flow_metrics(spark, sf):
    f = flows(spark, sf).select(F.when(F.col("orig") < "00100", "low").otherwise("high").alias("half"), F.col("migrants").alias("y"), (26.0 * F.col("migrants_unweighted")).alias("p"))
    return models.flow_metrics(f, "y", "p", "half").select("half", r("cpc", 6), r("rmse"), r("rmse_log", 5), r("r2", 5), r("r2_log", 5), r("poisson_nll", 3))


@query(f"""WITH {s.VINTAGES}, cuts AS (SELECT list_distinct(quantile_cont(pop_2, [{', '.join(str(i / 10) for i in range(1, 10))}])) AS c FROM v2)
SELECT CAST(len(list_filter(c, lambda x: x < pop_2)) AS INT) AS bin, round(avg(pop_2), 4) AS mean_x, round(avg(income_2), 4) AS mean_y, count(*) AS n FROM v2, cuts GROUP BY 1""")
def quantile_bins(spark, sf):
    return models.quantile_bins(s.vintages(spark, sf)[1], "pop_2", "income_2", 10).select("bin", r("mean_x"), r("mean_y"), "n")


@query(f"WITH {s.RECORDS}, {s.FLOWS} SELECT orig, dest, migrants FROM flows WHERE orig <> dest ORDER BY migrants DESC, orig, dest LIMIT 50")
def top_edges(spark, sf):
    return route.split_diagonal(flows(spark, sf))[1].orderBy(F.desc("migrants"), "orig", "dest").limit(50).select("orig", "dest", "migrants")


@query(f"WITH {s.RECORDS}, {s.FLOWS} SELECT orig, sum(migrants) AS outflow, count(*) AS destinations, round(avg(migrants), 4) AS mean_flow FROM flows WHERE orig <> dest GROUP BY 1")
def outflow_totals(spark, sf):
    away = route.split_diagonal(flows(spark, sf))[1]
    return away.groupBy("orig").agg(F.sum("migrants").alias("outflow"), F.count(F.lit(1)).alias("destinations"), F.round(F.avg("migrants"), 4).alias("mean_flow"))


@query()
def gravity_model(spark, sf):
    """Coefficients of a Poisson gravity model; no SQL equivalent, see the tests for its closed form."""
    a, b = s.vintages(spark, sf)
    rows = panel.attach_both_roles(dense(spark, sf), b.select("code", "pop_2")).join(s.distances(spark, sf), ["orig", "dest"])
    rows = rows.select("migrants", F.ln("pop_2_orig").alias("log_pop_orig"), F.ln("pop_2_dest").alias("log_pop_dest"), F.ln("km").alias("log_km")).dropna()
    names = ["log_pop_orig", "log_pop_dest", "log_km"]
    model = models.ppml_gravity(rows, "migrants", names)
    found = [("intercept", float(model.intercept)), *zip(names, map(float, model.coefficients), strict=True)]
    return spark.createDataFrame(found, "term string, coefficient double")


def load() -> None:
    """The other modules of queries register themselves when they are imported."""
    from dyadflow.plans import modelling, places, routing  # noqa: F401


def queries() -> dict:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    load()
    return dict(SQL)
