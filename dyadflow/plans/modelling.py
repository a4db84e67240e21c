"""Queries of fills, classes, gates, samples, spatial statistics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadflow.functions.keys import film_gate, from_log1p, non_negative
from dyadflow.operators import forests, models, panel, quality, space, statistics
from dyadflow.plans import standins as s
from dyadflow.plans.catalog import KNN, SPLIT, dense, flows, neighbours, query, r, splits
from dyadflow.sources.tables import written


@query("SELECT share, round(quantile_cont(o_totalprice, share), 4) AS quantile FROM orders, (SELECT unnest([0.1, 0.25, 0.5, 0.9, 1.0])::DOUBLE AS share) GROUP BY share".replace("quantile_cont(o_totalprice, share)", "CASE share " + " ".join(f"WHEN {q} THEN quantile_cont(o_totalprice, {q})" for q in (0.1, 0.25, 0.5, 0.9, 1.0)) + " END"))
def exact_quantiles(spark, sf):
    return quality.exact_quantiles(s.table(spark, sf, "orders"), "o_totalprice", [0.1, 0.25, 0.5, 0.9, 1.0]).select("share", r("quantile"))


@query(f"""WITH {s.VINTAGES}, c AS (SELECT quantile_cont(income_2, [0.2, 0.4, 0.6, 0.8]) AS c FROM v2 WHERE CAST(code AS INT) % 9 <> 0)
SELECT code, CASE WHEN CAST(code AS INT) % 9 <> 0 THEN CAST(len(list_filter(c, lambda x: x < income_2)) AS INT) END AS class FROM v2, c""")
def map_classes(spark, sf):
    gaps = s.vintages(spark, sf)[1].select("code", F.when(F.col("code").cast("int") % 9 != 0, F.col("income_2")).alias("income_2"))
    return quality.quantile_classes(gaps, "code", "income_2").select("code", "class")


GAPS = "g AS (SELECT code, substr(code, 1, 4) AS state, CASE WHEN CAST(code AS INT) % 4 <> 0 AND CAST(code AS INT) NOT BETWEEN 50 AND 59 THEN income_2 END AS x FROM v2)"


def with_gaps(spark, sf):
    z = F.col("code").cast("int")
    return s.vintages(spark, sf)[1].select("code", F.when((z % 4 != 0) & ~z.between(50, 59), F.col("income_2")).alias("x"))


@query(f"WITH {s.VINTAGES}, {GAPS} SELECT code, round(coalesce(x, (SELECT avg(x) FROM g)), 4) AS x FROM g")
def filled_by_column_mean(spark, sf):
    return quality.column_mean_fill(with_gaps(spark, sf), ["x"]).select("code", r("x"))


@query(f"WITH {s.VINTAGES}, {GAPS} SELECT code, round(coalesce(x, avg(x) OVER (PARTITION BY state), 7.0), 4) AS x FROM g")
def filled_by_group_mean(spark, sf):
    return quality.group_mean_fill(with_gaps(spark, sf), F.substring("code", 1, 4), {"x": 7.0}).select("code", r("x"))


@query(f"""WITH {s.CELLS}, z AS (SELECT zone, sum(CASE WHEN value IS NOT NULL THEN value * weight END) / sum(CASE WHEN value IS NOT NULL THEN weight END) AS m, avg(value) AS p FROM cells GROUP BY 1)
SELECT round(avg(abs(m - p)), 7) AS mean_delta, round(max(abs(m - p)), 7) AS max_delta, count(abs(m - p)) AS n FROM z""")
def weighting_delta(spark, sf):
    return quality.weighting_delta(space.zonal_mean(s.cells(spark, sf), "zone"), "mean", "plain_mean").select(r("mean_delta", 7), r("max_delta", 7), "n")


@query(f"WITH {s.RECORDS}, {s.FLOWS}, {s.VINTAGES} SELECT orig, sum(migrants) AS outflow, count(*) AS destinations, round(avg(pop_2), 4) AS pop_2 FROM flows LEFT JOIN v2 ON dest = code GROUP BY 1")
def outflow_and_features(spark, sf):
    rows = flows(spark, sf).join(s.vintages(spark, sf)[1].select(F.col("code").alias("dest"), "pop_2"), "dest", "left")
    return quality.flow_totals_by_source(rows, "migrants", ["pop_2"]).select("orig", "outflow", "destinations", r("pop_2"))


@query(f"""WITH {s.RECORDS}, {s.FLOWS}, {s.UNITS}, m AS (SELECT orig, avg(26.0 * n - migrants) AS residual FROM flows WHERE CAST(orig AS INT) % 5 <> 0 GROUP BY 1)
SELECT code, round(residual, 4) AS residual, residual IS NOT NULL AS present FROM units LEFT JOIN m ON orig = code""")
def residuals_by_source(spark, sf):
    rows = flows(spark, sf).where(F.col("orig").cast("int") % 5 != 0).select("orig", F.col("migrants").alias("y"), (26.0 * F.col("migrants_unweighted")).alias("p"))
    return quality.node_mean_residual(s.units(spark, sf), rows, "y", "p").select("code", r("residual"), "present")


@query(f"WITH {s.UNITS} SELECT code, row_number() OVER (ORDER BY code) - 1 AS idx FROM units")
def node_indexes(spark, sf):
    return models.node_index(s.units(spark, sf))


@query(f"WITH {s.RECORDS}, {s.FLOWS}, {s.UNITS}, i AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS idx FROM units WHERE CAST(code AS INT) % 11 <> 0) SELECT orig, dest, a.idx AS src_idx, b.idx AS dst_idx FROM flows LEFT JOIN i a ON a.code = orig LEFT JOIN i b ON b.code = dest")
def flows_by_node_index(spark, sf):
    index = models.node_index(s.units(spark, sf).where(F.col("code").cast("int") % 11 != 0))
    return models.map_to_node_idx(flows(spark, sf).select("orig", "dest"), index)


@query(f"""WITH {s.RECORDS}, {s.FLOWS}, {s.VINTAGES}, e AS (SELECT a.code, a.pop_2, a.income_2 FROM flows JOIN v2 a ON a.code = orig UNION SELECT b.code, b.pop_2, b.income_2 FROM flows JOIN v2 b ON b.code = dest)
SELECT code, pop_2, round(income_2, 4) AS income_2 FROM e""")
def nodes_of_the_flows(spark, sf):
    both = panel.attach_both_roles(flows(spark, sf), s.vintages(spark, sf)[1])
    rows = both.where("pop_2_orig IS NOT NULL AND pop_2_dest IS NOT NULL").select(*[F.col(c if c in ("orig", "dest") else f"{c}_{role}").alias(f"{p}_{'code' if c in ('orig', 'dest') else c}") for p, role in (("src", "orig"), ("dst", "dest")) for c in (role, "pop_2", "income_2")])
    return models.node_frame(rows).select("code", "pop_2", r("income_2"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) WHERE i = 1")
def first_order_of_each(spark, sf):
    kept = models.unique_keep_first(s.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return kept.select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"WITH {s.UNITS}, {s.RECORDS}, {s.FLOWS} SELECT a.code AS orig, b.code AS dest FROM units a, units b WHERE a.code < b.code AND CAST(a.code AS INT) % 10 = 0 AND (a.code, b.code) NOT IN (SELECT (orig, dest) FROM flows)")
def pairs_without_a_flow(spark, sf):
    pairs = panel.build_spine(s.units(spark, sf)).where((F.col("orig") < F.col("dest")) & (F.col("orig").cast("int") % 10 == 0))
    return models.anti_known_pairs(pairs, flows(spark, sf))


@query(f"WITH {s.RECORDS}, {s.FLOWS}, m AS (SELECT count(*) AS n FROM flows) SELECT n + CAST(floor(0.3 * n) AS BIGINT) AS n_rows, CAST(floor(0.3 * n) AS BIGINT) AS n_negative, 0::BIGINT AS n_unknown FROM m")
def duplicated_negatives(spark, sf):
    """How many rows with the negatives, how many negatives, and how many of them are no copy of a positive."""
    known = flows(spark, sf).select("orig", "dest", "migrants")
    rows = models.duplicate_negatives(known, "migrants", ["orig", "dest"])
    counted = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("migrants") == 0).alias("n_negative"))
    strange = models.anti_known_pairs(rows, known).agg(F.count(F.lit(1)).alias("n_unknown"))
    return counted.join(F.broadcast(strange))


#: A tenth of the records, so that pairs are absent; many records leave few or none.
FEW = "few AS (SELECT DISTINCT orig, dest FROM records WHERE sentinel = 0)"


@query(f"""WITH {s.RECORDS}, {s.UNITS}, {FEW}, absent AS MATERIALIZED (SELECT a.code AS orig, b.code AS dest, row_number() OVER (ORDER BY a.code, b.code) - 1 AS rank
  FROM units a JOIN units b ON a.code <> b.code WHERE NOT EXISTS (SELECT 1 FROM few WHERE few.orig = a.code AND few.dest = b.code)), t AS (SELECT count(*) AS t FROM absent),
cuts AS (SELECT k, k * t // 500 AS lo, (k + 1) * t // 500 AS hi FROM range(500) r(k), t)
SELECT orig, dest, 0.0::DOUBLE AS dist_km, 0.0::DOUBLE AS y FROM cuts JOIN absent ON rank = lo + (k * 7919 + 7 * 104729) % (hi - lo)""")
def unseen_negatives(spark, sf):
    """500 pairs without a flow among a tenth of the records, or all where fewer are left."""
    known = s.records(spark, sf).where("sentinel = 0").select("orig", "dest")
    return models.unseen_pair_negatives(known, s.units(spark, sf), 500, ["dist_km"], "y", at_most=True)


@query(f"WITH {s.RECORDS}, {s.FLOWS}, {s.VINTAGES}, {SPLIT} SELECT CASE WHEN a.split = b.split THEN a.split ELSE 'inference' END AS split, count(*) AS dyads, round(sum(ln(1 + migrants)), 4) AS log_flow FROM flows LEFT JOIN sp a ON a.code = orig LEFT JOIN sp b ON b.code = dest GROUP BY 1")
def splits_without_leaks(spark, sf):
    units, rows = splits(spark, sf), models.null_gate(flows(spark, sf), ["orig", "dest", "migrants"])
    split = models.assert_split(rows, models.dyad_split(rows, units, "code"), units)
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("dyads"), F.round(F.sum(F.log1p("migrants")), 4).alias("log_flow"))


@query(f"""WITH {s.UNITS}, {s.VINTAGES}, a AS (SELECT * FROM units WHERE code NOT IN (SELECT code FROM v1 WHERE CAST(code AS INT) % 40 <> 0))
SELECT code FROM a""")
def units_without_a_value(spark, sf):
    values = s.vintages(spark, sf)[0].select("code", F.when(F.col("code").cast("int") % 40 != 0, F.col("income_1")).alias("income_1"))
    return quality.coverage_gate(s.units(spark, sf), values, "code", "income_1", least=0.5)[1]


@query(f"""WITH {s.RECORDS}, {s.UNITS}, {s.FLOWS}, {s.PANEL} SELECT 'rows' AS "check", CAST(count(*) AS DOUBLE) AS value, NULL::BOOLEAN AS passed FROM panel
UNION ALL SELECT 'repeated_pairs', CAST(count(*) - count(DISTINCT orig || dest) AS DOUBLE), count(*) = count(DISTINCT orig || dest) FROM panel
UNION ALL SELECT 'diagonal', CAST(count(*) FILTER (orig = dest) AS DOUBLE), count(*) FILTER (orig = dest) = 0 FROM panel
UNION ALL SELECT 'negative', CAST(count(*) FILTER (migrants < 0) AS DOUBLE), count(*) FILTER (migrants < 0) = 0 FROM panel
UNION ALL SELECT 'positive_pct', round(100.0 * count(*) FILTER (migrants > 0) / count(*), 6), count(*) FILTER (migrants > 0) > 0 FROM panel
UNION ALL SELECT 'missing_cells', CAST(count(*) FILTER (orig IS NULL OR dest IS NULL OR migrants IS NULL OR n IS NULL) AS DOUBLE), NULL FROM panel""")
def validation_report(spark, sf):
    return quality.validation_report(dense(spark, sf)).withColumn("value", F.round("value", 6))


@query(f"""WITH {s.RECORDS}, {s.FLOWS} SELECT 'orig' AS "column", 'origin code' AS definition, 'string' AS type, count(*) - count(orig) AS n_missing FROM flows UNION ALL SELECT 'dest', 'destination code', 'string', count(*) - count(dest) FROM flows
UNION ALL SELECT 'migrants', 'weighted persons', 'double', count(*) - count(migrants) FROM flows UNION ALL SELECT 'migrants_unweighted', 'records', 'bigint', count(*) - count(n) FROM flows""")
def codebook(spark, sf):
    names = [("orig", "origin code"), ("dest", "destination code"), ("migrants", "weighted persons"), ("migrants_unweighted", "records")]
    return quality.codebook(flows(spark, sf), spark.createDataFrame(names, "column string, definition string")).select("column", "definition", "type", "n_missing")


@query(f"""WITH {s.UNITS}, {s.POINTS}, {s.DISTANCES}, {KNN}, {s.VINTAGES}, e AS (SELECT orig, dest FROM knn UNION SELECT code, code FROM units), d AS (SELECT dest AS code, count(*) AS d FROM e GROUP BY 1)
SELECT e.dest AS code, round(sum(pop_2 / sqrt(a.d)) / sqrt(max(b.d)), 4) AS pop_2 FROM e JOIN d a ON a.code = e.orig JOIN d b ON b.code = e.dest JOIN v2 ON v2.code = e.orig GROUP BY 1""")
def propagated_features(spark, sf):
    return statistics.gcn_propagate(neighbours(spark, sf), s.vintages(spark, sf)[1], "code", ["pop_2"]).select("code", r("pop_2"))


@query("""WITH v AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS side, vec_id % 7 AS w, embedding FROM embeddings), l AS (SELECT side, w, unnest(range(0, len(embedding))) AS position, unnest(embedding) AS x FROM v WHERE w > 0)
SELECT side, CAST(position AS INT) AS position, round(sum(w * x) / sum(w), 5) AS mean FROM l GROUP BY 1, 2""")
def mean_vectors(spark, sf):
    rows = s.table(spark, sf, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("side"), (F.col("vec_id") % 7).alias("w"), "embedding")
    return statistics.weighted_embedding_mean(rows, ["side"], "embedding", "w").select("side", "position", r("mean", 5))


@query(f"""WITH {s.VINTAGES}, k AS (SELECT code, rank() OVER (ORDER BY pop_2) + (count(*) OVER (PARTITION BY pop_2) - 1) / 2.0 AS ra, rank() OVER (ORDER BY income_2) + (count(*) OVER (PARTITION BY income_2) - 1) / 2.0 AS rb FROM v2)
SELECT 'origin' AS role, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM k UNION ALL SELECT 'destination', count(*), round(corr(ra, ra), 6) FROM k""")
def rank_correlation_by_role(spark, sf):
    rows = s.vintages(spark, sf)[1]
    return statistics.spearman_by_role(rows, "code", {"origin": ("pop_2", "income_2"), "destination": ("pop_2", "pop_2")}).select("role", "n", r("spearman", 6))


@query(f"""WITH {s.VINTAGES}, m AS (SELECT count(*) AS n, avg(income_2) AS m, var_pop(income_2) AS v FROM v2), k AS (SELECT max(n) AS n, avg((income_2 - m) ** 3) / max(v) ** 1.5 AS s, avg((income_2 - m) ** 4) / max(v) ** 2 - 3 AS k FROM v2, m)
SELECT n, round(s, 5) AS skewness, round(k, 5) AS kurtosis, round(n / 6.0 * (s * s + k * k / 4), 4) AS jb FROM k""")
def normality(spark, sf):
    return statistics.jarque_bera(s.vintages(spark, sf)[1], "income_2").select("n", r("skewness", 5), r("kurtosis", 5), r("jb"))


@query(f"""WITH {s.VINTAGES}, m AS (SELECT regr_slope(income_2, pop_2) AS b, regr_intercept(income_2, pop_2) AS a, regr_r2(income_2, pop_2) AS r2, count(*) AS n FROM v2)
SELECT 'constant' AS term, round(a, 4) AS value FROM m UNION ALL SELECT 'pop_2', round(b, 4) FROM m UNION ALL SELECT 'r2', round(r2, 4) FROM m UNION ALL SELECT 'adj_r2', round(1 - (1 - r2) * (n - 1) / (n - 2), 4) FROM m""")
def least_squares(spark, sf):
    rows = s.vintages(spark, sf)[1].select(F.col("pop_2").cast("double").alias("pop_2"), "income_2")
    return statistics.ols_table(statistics.ols(rows, "income_2", ["pop_2"]), spark).where(F.col("term").isin("constant", "pop_2", "r2", "adj_r2")).select("term", r("value"))


def outflow_table(spark, sf):
    out = flows(spark, sf).groupBy(F.col("orig").alias("code")).agg(F.log1p(F.sum("migrants")).alias("y"))
    units = s.vintages(spark, sf)[1].select("code", F.ln("pop_2").alias("log_pop"), F.ln("income_2").alias("log_income"), (F.ln("pop_2") + F.ln("income_2")).alias("log_both"))
    return models.inner_join_features(out, units, s.points(spark, sf)).select("code", "y", "log_pop", "log_income", "log_both", "lat")


@query()
def outflow_diagnostics(spark, sf):
    """OLS on log outflow with all diagnostics, features of large inflation dropped first; closed forms are in the tests."""
    rows, weights = outflow_table(spark, sf).persist(), neighbours(spark, sf).persist()
    kept, dropped = statistics.vif_eliminate(rows, ["log_pop", "log_income", "log_both", "lat"])
    fit = statistics.ols(rows, "y", kept)
    found = statistics.breusch_pagan(rows, fit) | statistics.lm_spatial_tests(rows, weights, "code", fit) | statistics.spatial_durbin_tests(rows, weights, "code", fit) | {"condition_number": statistics.condition_number(fit), "dropped": ", ".join(name for name, _ in dropped)}
    tests = spark.createDataFrame([(k, None if isinstance(v, str) else float(v), v if isinstance(v, str) else None) for k, v in found.items()], "term string, value double, said string")
    return statistics.ols_table(fit, spark).select("term", "value", F.lit(None).cast("string").alias("said")).unionByName(tests)


@query()
def morans_i_by_permutation(spark, sf):
    return statistics.morans_i_permutation(neighbours(spark, sf), s.vintages(spark, sf)[1], "code", "income_2", permutations=99)


@query(f"""WITH {s.VINTAGES} SELECT code, round((1 + 0.5) * pop_2 + CASE WHEN CAST(code AS INT) % 2 = 0 THEN 3.0 ELSE -1.0 END, 4) AS pop_2, round(income_2, 4) AS income_2 FROM v2""")
def gated_features(spark, sf):
    rows = s.vintages(spark, sf)[1].select("code", F.when(F.col("code").cast("int") % 2 == 0, "even").otherwise("odd").alias("role"), F.col("pop_2").cast("double").alias("pop_2"), "income_2")
    parameters = spark.createDataFrame([("even", "pop_2", 0.5, 3.0), ("odd", "pop_2", 0.5, -1.0)], "role string, column string, gamma double, beta double")
    return film_gate(rows, parameters, "role", ["pop_2", "income_2"]).select("code", r("pop_2"), r("income_2"))


@query(f"WITH {s.RECORDS}, {s.FLOWS} SELECT orig, dest, round(greatest(migrants - 100, 0), 4) AS clipped, round(greatest(exp(ln(1 + migrants)) - 1, 0), 4) AS back FROM flows")
def clipped_predictions(spark, sf):
    return flows(spark, sf).select("orig", "dest", F.round(non_negative(F.col("migrants") - 100), 4).alias("clipped"), F.round(from_log1p(F.log1p("migrants")), 4).alias("back"))


def measured_pairs(spark, sf):
    return written(dense(spark, sf).join(s.distances(spark, sf), ["orig", "dest"]))


def gravity_rows(spark, sf, pairs=None):
    b = s.vintages(spark, sf)[1].select("code", "pop_2")
    full = panel.attach_both_roles(pairs or measured_pairs(spark, sf), b)
    return models.gravity_design(full.withColumn("orig_zone", F.col("orig")), "migrants", "pop_2_orig", "pop_2_dest", "km")


@query()
def gravity_coefficients(spark, sf):
    """The Poisson model with standard errors."""
    names = ["log_pop_orig", "log_pop_dest", "log_km"]
    return models.coefficient_table(models.ppml_gravity(gravity_rows(spark, sf), "migrants", names), names)


def forest_rows(spark, sf):
    out = models.map_to_node_idx(flows(spark, sf), models.node_index(s.units(spark, sf))).join(s.distances(spark, sf), ["orig", "dest"])
    return panel.attach_both_roles(out, s.vintages(spark, sf)[1])


FOREST = ["pop_2_orig", "pop_2_dest", "income_2_orig", "income_2_dest", "km"]


def forest(spark, sf):
    return forests.forest_regression(forest_rows(spark, sf), FOREST, "migrants", ["orig", "dest"], leaves=[20, 50], trees=[10, 20])


@query()
def forest_importances(spark, sf):
    """Importances of a forest on log flows, tuned by out-of-bag errors."""
    return quality.rank_importance(forest(spark, sf)[1], spark)


@query()
def forest_trials(spark, sf):
    """The out-of-bag error of every forest that was tried."""
    return forest(spark, sf)[2]


@query()
def permutation_importances(spark, sf):
    """How far the common part of commuters falls for each class of origins when a unit feature is permuted."""
    names = ["log_pop_orig", "log_pop_dest", "log_km"]
    pairs, classes = measured_pairs(spark, sf), splits(spark, sf).select(F.col("code").alias("orig"), "stratum")
    model = models.ppml_gravity(gravity_rows(spark, sf, pairs), "migrants", names)

    def score(units):
        rows = panel.attach_both_roles(pairs, units).join(classes, "orig")
        eta = F.lit(float(model.intercept)) + sum(F.ln(F.col(c)) * float(b) for c, b in zip(("pop_2_orig", "pop_2_dest", "km"), model.coefficients, strict=True))
        return rows.select("stratum", F.col("migrants").alias("y"), F.exp(eta).alias("p"))

    return models.permutation_importance(score, s.vintages(spark, sf)[1].select("code", "pop_2"), "code", ["pop_2"], by=["stratum"])
