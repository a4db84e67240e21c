"""Queries of the readers' and routing operators: raw fields to buckets, keys, years, ages, bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadflow.functions.keys import canonical_state, deflate_ppp, rename_final, stamp_constants, state_of, suffix_columns, unit_convert
from dyadflow.operators import fold, panel, quality, route
from dyadflow.plans import standins as s
from dyadflow.plans.catalog import flows, query, r
from dyadflow.sources import tables

#: Raw fields of person records: text as a census file has it, with its sentinels.
RAW = f"""raw AS (SELECT l_partkey % 90 AS age, CASE l_orderkey % 10 WHEN 9 THEN '99' WHEN 8 THEN CAST(33 + l_partkey % 60 AS VARCHAR) WHEN 7 THEN '' WHEN 6 THEN ' 0 ' ELSE CAST(1 + o_custkey % 32 AS VARCHAR) END AS state,
  CASE WHEN l_orderkey % 20 = 5 THEN '999' WHEN l_orderkey % 20 = 3 THEN 'n/a' ELSE CAST(l_suppkey % 570 AS VARCHAR) END AS unit, {s.Z.format('l_suppkey')} AS dest, CAST(l_quantity AS VARCHAR) AS factor, l_quantity AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
BUCKET = "CASE WHEN age < 5 THEN 'under_age' WHEN state = '99' OR unit = '999' THEN 'not_specified' WHEN try_cast(trim(state) AS INT) >= 33 THEN 'foreign' WHEN trim(state) IN ('', '0') THEN 'non_migrant' ELSE 'domestic' END"


def raw(spark, sf):
    o, l = s.table(spark, sf, "orders"), s.table(spark, sf, "lineitem")
    rest, text = F.col("l_orderkey") % 10, lambda c: c.cast("string")
    state = F.when(rest == 9, "99").when(rest == 8, text(33 + F.col("l_partkey") % 60)).when(rest == 7, "").when(rest == 6, " 0 ").otherwise(text(1 + F.col("o_custkey") % 32))
    unit = F.when(F.col("l_orderkey") % 20 == 5, "999").when(F.col("l_orderkey") % 20 == 3, "n/a").otherwise(text(F.col("l_suppkey") % 570))
    joined = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select((F.col("l_partkey") % 90).alias("age"), state.alias("state"), unit.alias("unit"), s.zone("l_suppkey").alias("dest"), text(F.col("l_quantity")).alias("factor"), F.col("l_quantity").alias("w"))


def bucketed(spark, sf):
    named = route.classify_origin(F.col("age"), F.col("state"), F.col("unit"), not_specified=(["99"], ["999"]), foreign_from=33, non_migrant=["0"])
    return raw(spark, sf).withColumn("bucket", named)


@query(f"WITH {RAW} SELECT {BUCKET} AS bucket, count(*) AS records, sum(w) AS weighted, round(100.0 * count(*) / (SELECT count(*) FROM raw), 4) AS pct FROM raw GROUP BY 1")
def raw_origin_buckets(spark, sf):
    return route.reconcile(bucketed(spark, sf)).withColumn("pct", F.round("pct", 4))


ORIGIN = "CASE WHEN try_cast(trim(unit) AS INT) IS NOT NULL AND try_cast(trim(state) AS INT) IS NOT NULL THEN lpad(trim(state), 2, '0') || lpad(unit, 3, '0') END"


@query(f"""WITH {RAW}, b AS (SELECT *, {BUCKET} AS b0, {ORIGIN} AS orig FROM raw)
SELECT CASE WHEN b0 = 'domestic' AND orig IS NULL THEN 'unparseable_code' ELSE b0 END AS bucket, dest, sum(CAST(factor AS DOUBLE)) AS migrants, count(*) AS migrants_unweighted FROM b
WHERE b0 IN ('foreign', 'not_specified') OR (b0 = 'domestic' AND orig IS NULL) GROUP BY 1, 2""")
def excluded_raw_flows(spark, sf):
    code = F.concat(F.lpad(F.trim("state"), 2, "0"), F.when(F.col("unit").try_cast("int").isNotNull(), F.lpad("unit", 3, "0")))
    rows = route.rebucket_unparseable(bucketed(spark, sf).withColumn("orig", code))
    return route.select_excluded(route.record_weights(rows.drop("w"), full_count=False), ["foreign", "not_specified", "unparseable_code"])


@query(f"WITH {s.RECORDS} SELECT orig, dest, CAST(count(*) AS DOUBLE) AS migrants, count(*) AS migrants_unweighted FROM records GROUP BY 1, 2")
def full_count_flows(spark, sf):
    return route.require_full_count(route.aggregate_od(route.record_weights(s.records(spark, sf).drop("w"), full_count=True)))


@query("""WITH d AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || lpad(CAST(r AS VARCHAR), 3, '0') AS code, CASE WHEN r % 2 = 0 THEN '0' ELSE lpad(CAST(r AS VARCHAR), 4, '0') END AS loc, c_custkey, c_acctbal
  FROM (SELECT *, c_custkey % 4 AS r FROM customer) JOIN nation ON c_nationkey = n_nationkey)
SELECT code, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM d WHERE lpad(loc, 4, '0') = '0000' AND code NOT LIKE '%000' GROUP BY 1""")
def unit_total_rows(spark, sf):
    """Totals of units among rows of their parts, without the totals of states."""
    rest = F.col("c_custkey") % 4
    code = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad(rest.cast("string"), 3, "0"))
    loc = F.when(rest % 2 == 0, "0").otherwise(F.lpad(rest.cast("string"), 4, "0"))
    rows = s.table(spark, sf, "customer").select(code.alias("code"), loc.alias("loc"), "c_custkey")
    return route.drop_aggregate_codes(route.total_rows_only(rows, "loc"), "code").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("ids"))


@query(f"SELECT {s.Z.format('o_custkey')} AS code, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1")
def orders_of_a_year(spark, sf):
    rows = s.table(spark, sf, "orders").select(s.zone("o_custkey").alias("code"), F.year("o_orderdate").cast("string").alias("year"))
    return route.filter_year(rows, "year", 1995).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {s.Z.format('p_partkey')} AS code, 3 * p_size AS age, CAST(sum(1) AS BIGINT) AS n FROM part WHERE 3 * p_size <= 130 GROUP BY 1, 2")
def ages_without_sentinels(spark, sf):
    people = s.table(spark, sf, "part").select(s.zone("p_partkey").alias("code"), (3 * F.col("p_size")).alias("age"), F.lit(1).alias("w"))
    return fold.weighted_ages(route.drop_age_sentinels(people, "age"), "code", "age", "w")


@query("""SELECT 'o_totalprice' AS "column", 1000.0 AS low, 300000.0 AS high, count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 300000) AS n_outside FROM orders UNION ALL
SELECT 'o_orderkey', 0.0, 1e12, count(*) FILTER (o_orderkey < 0 OR o_orderkey > 1e12) FROM orders""")
def values_out_of_range(spark, sf):
    rows = s.table(spark, sf, "orders").withColumn("code", F.col("o_orderkey").cast("string"))
    return route.range_flags(rows, "code", {"o_totalprice": (1000, 300000), "o_orderkey": (0, 1e12)}).select("column", "low", "high", "n_outside")


@query("SELECT count(*) FILTER (o_custkey % 7 = 0) AS dropped, count(*) FILTER (o_custkey % 7 <> 0) AS kept FROM orders")
def keys_dropped(spark, sf):
    return route.dropna_keys(s.table(spark, sf, "orders").withColumn("code", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))), ["code", "o_orderkey"])[1]


@query("SELECT o_orderkey, lpad(CAST(o_orderkey % 32 AS VARCHAR), 2, '0') AS state, lpad(CAST(o_orderkey % 32 AS VARCHAR), 2, '0') AS of_code, round(o_totalprice * 1000, 2) AS mm, round((o_totalprice - 32) / 1.8, 4) AS celsius FROM orders")
def states_and_units(spark, sf):
    wide = F.lpad((F.col("o_orderkey") % 32).cast("string"), 3, "0")
    rows = s.table(spark, sf, "orders").withColumn("state", canonical_state(wide))
    return rows.select("o_orderkey", "state", state_of(F.concat("state", F.lit("001"))).alias("of_code"), F.round(unit_convert(F.col("o_totalprice"), "m", "mm"), 2).alias("mm"), F.round(unit_convert(F.col("o_totalprice"), "F", "C"), 4).alias("celsius"))


@query(f"WITH {s.VINTAGES} SELECT code, round(income_2 * CASE WHEN CAST(code AS INT) % 2 = 0 THEN 0.95 ELSE 1 END / 10.5, 4) AS income, '2017' AS base_year FROM v2")
def incomes_deflated(spark, sf):
    even = F.col("code").cast("int") % 2 == 0
    _, b = s.vintages(spark, sf)
    rows = b.select("code", deflate_ppp(F.col("income_2"), F.when(even, F.lit(0.95)), F.lit(10.5), ~even).alias("real"))
    return stamp_constants(rename_final(rows, {"real": "income"}), base_year="2017").withColumn("income", F.round("income", 4))


@query(f"WITH {s.VINTAGES} SELECT code, round(income_2, 4) AS income_2_dest, pop_2 AS pop_2_dest FROM v2")
def unit_table_of_a_role(spark, sf):
    return suffix_columns(s.vintages(spark, sf)[1], ["code"], "_dest").select("code", r("income_2_dest"), "pop_2_dest")


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, CAST(coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN o_custkey END), 0) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def residual_dimension_collapsed(spark, sf):
    rows = s.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("n"))
    return fold.collapse_dimension(rows, ["priority", "status"], "n")


@query(f"""WITH y AS (SELECT {s.Z.format('o_custkey')} AS code, year(o_orderdate) AS year, CASE WHEN o_custkey % 5 <> 0 THEN sum(floor(o_totalprice)) END AS v FROM orders GROUP BY o_custkey % 200, o_custkey % 5, year(o_orderdate))
SELECT code, round(avg(v), 4) AS v FROM y GROUP BY 1""")
def averages_over_years(spark, sf):
    years = s.table(spark, sf, "orders").groupBy(s.zone("o_custkey").alias("code"), (F.col("o_custkey") % 5).alias("k"), F.year("o_orderdate").alias("year")).agg(F.sum(F.floor("o_totalprice")).alias("v"))
    return fold.average_over_years(years.withColumn("v", F.when(F.col("k") != 0, F.col("v"))), "code", "v").select("code", r("v"))


@query(f"""WITH m AS (SELECT {s.Z.format('o_custkey')} AS code, o_orderpriority AS method, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT code, method, n FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, method) AS i FROM m) WHERE i = 1""")
def modal_methods(spark, sf):
    return fold.modal_method(s.table(spark, sf, "orders").select(s.zone("o_custkey").alias("code"), F.col("o_orderpriority").alias("method")), "code", "method")


BANDS = {"a0": (0, 9), "a10": (10, 19), "a20": (20, 29), "a30": (30, 39), "a40": (40, 50)}


@query(f"""WITH b AS (SELECT {s.Z.format('p_partkey')} AS code, {', '.join(f'count(*) FILTER (p_size BETWEEN {lo} AND {hi}) AS {name}' for name, (lo, hi) in BANDS.items())} FROM part GROUP BY 1)
SELECT code, CAST(a10 + a20 AS DOUBLE) AS part, CAST(a10 + a20 + a30 + a40 AS DOUBLE) AS whole, round(CASE WHEN a10 + a20 + a30 + a40 > 0 THEN (a10 + a20) / (a10 + a20 + a30 + a40) END, 6) AS share FROM b""")
def shares_of_age_bands(spark, sf):
    counts = [F.count_if(F.col("p_size").between(lo, hi)).cast("string").alias(name) for name, (lo, hi) in BANDS.items()]
    wide = s.table(spark, sf, "part").groupBy(s.zone("p_partkey").alias("code")).agg(*counts, F.count_if(F.col("p_size") >= 10).alias("published"))
    return fold.banded_share(wide, "code", BANDS, (10, 29), (10, 50), "published").withColumn("share", F.round("share", 6))


@query(f"""WITH {s.UNITS}, {s.CROSSWALK}, {s.VINTAGES}, v AS (SELECT code, income_2, pop_2 FROM v2), f AS (SELECT coalesce(parent, code) AS code, sum(income_2 * pop_2) / sum(pop_2) AS income, count(*) AS n, max(CAST(code AS INT)) * 1.0 AS se FROM v LEFT JOIN xw ON code = child GROUP BY 1)
SELECT code, round(income, 4) AS income, CASE WHEN n = 1 THEN se END AS se, CASE WHEN n > 1 THEN 'survey_harmonized' ELSE 'survey' END AS source FROM f""")
def incomes_folded(spark, sf):
    _, b = s.vintages(spark, sf)
    rows = b.select("code", F.col("income_2").alias("income"), "pop_2", F.col("code").cast("double").alias("se"), F.lit("survey").alias("source"))
    moved = fold.apply_crosswalk(rows, "code", fold.validate_crosswalk(s.crosswalk(spark, sf)))
    return fold.fold_income(moved, "code", "income", "pop_2", ["se"], "source").select("code", r("income"), "se", "source")


@query(f"WITH {s.UNITS}, {s.CROSSWALK}, {s.RECORDS} SELECT parent, count(*) AS n FROM records JOIN xw ON dest = child GROUP BY 1")
def crosswalk_hits(spark, sf):
    return fold.crosswalk_hits(s.records(spark, sf), "dest", s.crosswalk(spark, sf))


@query(f"WITH {s.VINTAGES} SELECT coalesce(v1.code, v2.code) AS code, round(pop_1, 2) AS pop_1, CAST(pop_2 AS DOUBLE) AS pop_2, CAST(NULL AS DOUBLE) AS pop_3, CAST(pop_2 AS DOUBLE) AS pop FROM v1 FULL JOIN v2 ON v1.code = v2.code")
def canonical_population(spark, sf):
    both = fold.outer_with_indicator(*s.vintages(spark, sf), "code").select("code", r("pop_1", 2), F.col("pop_2").cast("double").alias("pop_2"))
    return fold.canonical_alias(both, {2015: "pop_1", 2020: "pop_2", 2025: "pop_3"}, 2020, "pop")


@query(f"""WITH {s.RECORDS}, {s.FLOWS}, {s.UNITS}, known AS (SELECT code FROM units WHERE CAST(code AS INT) % 3 <> 0), l AS (SELECT DISTINCT orig AS code FROM flows)
SELECT count(*) AS n_left, count(*) FILTER (code IN (SELECT code FROM known)) AS n_matched, count(*) FILTER (code NOT IN (SELECT code FROM known)) AS n_unmatched, (SELECT count(*) FROM known WHERE code NOT IN (SELECT code FROM l)) AS n_right_unused FROM l""")
def audit_of_a_join(spark, sf):
    senders = flows(spark, sf).select(F.col("orig").alias("code")).distinct()
    return panel.join_audit(senders, s.units(spark, sf).where(F.col("code").cast("int") % 3 != 0), ["code"])


@query("""SELECT l_partkey % 50 AS col, l_orderkey % 50 AS row, round(avg(CASE WHEN l_tax <> 0 THEN CAST(round(l_tax * 100) AS DOUBLE) * 0.5 - 2 END), 6) AS value FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2""")
def raster_band_over_years(spark, sf):
    """One band of a raster with scale, offset and nodata, averaged over time."""
    raster = s.table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("col"), (F.col("l_orderkey") % 50).alias("row"), (F.col("l_linenumber") % 2).alias("band"), F.round(F.col("l_tax") * 100).alias("value"), F.year("l_shipdate").alias("year"))
    cells = tables.raster_cells(raster, 1, scale=0.5, offset=-2.0, nodata=0.0)
    return tables.collapse_time(cells.drop("band"), ["col", "row"], None).withColumn("value", F.round("value", 6))


@query("SELECT 'orders' AS step, CAST(NULL AS BIGINT) AS rows_in, count(*) AS rows_out, CAST(NULL AS BIGINT) AS delta FROM orders UNION ALL SELECT 'large', (SELECT count(*) FROM orders), count(*), count(*) - (SELECT count(*) FROM orders) FROM orders WHERE o_totalprice > 100000")
def rows_of_each_step(spark, sf):
    orders = s.table(spark, sf, "orders")
    return quality.rows_in_out([("orders", orders), ("large", orders.where("o_totalprice > 100000"))])
