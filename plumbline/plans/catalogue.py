"""The query catalogue: every operator over the driver tables, with DuckDB SQL of the same rows.

Control points come from orders, stations from supplier, targets from customer, raster cells from part,
residuals from lineitem and series from events, by integer arithmetic that both engines share.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import text as X
from ..functions import time as T
from ..operators import epoch as E
from ..operators import families as Y
from ..operators import network as N
from ..operators import raster as R
from ..operators import spatial as S
from ..operators import stats as A
from ..operators.landing import land, transform_control, transform_points
from ..sources.datasheets import dedupe_first
from ..sources.stations import median_lon, positions, select_window

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    # adding 0.0 turns a negative zero into zero
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded and all counts as long, for comparison."""
    return df.select(*[r(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# the mapping


def control(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    p = F.col("o_orderpriority")
    source = F.when(p.isin("1-URGENT", "2-HIGH"), "3dep").when(p == "3-MEDIUM", "opus").when(p == "4-NOT SPECIFIED", "ngs").otherwise("faa")
    kind = F.when(p == "1-URGENT", "NVA").when(p == "2-HIGH", "VVA").when(p == "3-MEDIUM", "gnss").when(p == "4-NOT SPECIFIED", "monument").otherwise("runway_end")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), (F.lit(-125.0) + (k * 7919 % 58000) / 1000.0).alias("x"), (F.lit(25.0) + (k * 1047 % 24000) / 1000.0).alias("y"),
        (F.col("o_totalprice") / 1000.0).alias("height"), source.alias("source"), kind.alias("point_type"), T.decyear(F.col("o_orderdate")).alias("coord_epoch"),
    )


DECYEAR = "(year({0}) + (epoch_us({0}) - epoch_us(make_timestamp(year({0}),1,1,0,0,0)))::DOUBLE / (epoch_us(make_timestamp(year({0})+1,1,1,0,0,0)) - epoch_us(make_timestamp(year({0}),1,1,0,0,0))))"
CONTROL = f"""control AS (SELECT o_orderkey AS id, -125e0 + (o_orderkey * 7919 % 58000) / 1000e0 AS x, 25e0 + (o_orderkey * 1047 % 24000) / 1000e0 AS y,
  o_totalprice / 1000e0 AS height,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN '3dep' WHEN o_orderpriority = '3-MEDIUM' THEN 'opus' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'ngs' ELSE 'faa' END AS source,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'NVA' WHEN '2-HIGH' THEN 'VVA' WHEN '3-MEDIUM' THEN 'gnss' WHEN '4-NOT SPECIFIED' THEN 'monument' ELSE 'runway_end' END AS point_type,
  {DECYEAR.format("o_orderdate")} AS coord_epoch FROM orders)"""


def residuals(spark: SparkSession, d: str, flavour: str) -> DataFrame:
    v = F.col("l_extendedprice")
    v = v + F.when(F.col("l_orderkey") % 97 == 0, 1e6).otherwise(0.0) if flavour == "heavy" else v
    v = F.when(F.col("l_orderkey") % 5 < 3, 0.0).otherwise(F.col("l_discount")) if flavour == "collapsed" else v
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", v.alias("v"))


_V = {
    "plain": "l_extendedprice", "heavy": "l_extendedprice + CASE WHEN l_orderkey % 97 = 0 THEN 1e6 ELSE 0e0 END",
    "collapsed": "CASE WHEN l_orderkey % 5 < 3 THEN 0e0 ELSE l_discount END",
}


def _residuals(flavour: str) -> str:
    return f"src AS (SELECT l_returnflag, l_linestatus, {_V[flavour]} AS v FROM lineitem)"


def spread_sql(by: str) -> str:
    """med and nmad by group of src."""
    return f"""md AS (SELECT {by}, median(v) AS med FROM src GROUP BY {by}),
nm AS (SELECT {by}, any_value(med) AS med, 1.4826e0 * median(abs(v - med)) AS nmad FROM src JOIN md USING ({by}) GROUP BY {by})"""


def report_sql(by: str) -> str:
    return f"""{spread_sql(by)},
g AS (SELECT src.*, med, nmad, CASE WHEN nmad = 0 OR abs(v - med) <= 3 * nmad THEN v END AS u FROM src JOIN nm USING ({by})),
rep AS (SELECT {by}, count(v) AS n, any_value(med) AS median, any_value(nmad) AS nmad, count(u) AS n_used, count(v) - count(u) AS n_outliers, avg(u) AS mean,
  stddev_samp(u) AS std, sqrt(avg(u * u)) AS rmse, quantile_cont(abs(u), 0.9) AS le90, quantile_cont(abs(u), 0.95) AS le95 FROM g GROUP BY {by})"""


_REPORT = "n, round(median,6) AS median, round(nmad,6) AS nmad, n_used, n_outliers, round(mean,6) AS mean, round(std,6) AS std, round(rmse,6) AS rmse, round(le90,6) AS le90, round(le95,6) AS le95"

# A: statistics


@query(f"WITH {_residuals('plain')}, {spread_sql('l_returnflag')} SELECT l_returnflag, count(v) AS n, round(any_value(med),6) AS median, round(any_value(nmad),6) AS nmad FROM src JOIN nm USING (l_returnflag) GROUP BY l_returnflag")
def med_nmad_by_flag(spark, d):
    return rounded(A.med_nmad(residuals(spark, d, "plain"), "v", ["l_returnflag"]))


@query(f"WITH {_residuals('plain')}, {spread_sql('l_returnflag')} SELECT l_returnflag, count(v) AS n, round(any_value(med),6) AS median, round(avg(v),6) AS mean, round(any_value(nmad),6) AS nmad, round(stddev_pop(v),6) AS std, round(sqrt(avg(v*v)),6) AS rmse FROM src JOIN nm USING (l_returnflag) GROUP BY l_returnflag")
def resid_stats_by_flag(spark, d):
    return rounded(A.resid_stats(residuals(spark, d, "plain"), "v", ["l_returnflag"]))


def _report_query(flavour: str, by: str) -> Query:
    return lambda spark, d: rounded(A.error_report(residuals(spark, d, flavour), "v", [by]))


for _name, _flavour, _by in (("error_report_by_segment", "plain", "l_returnflag"), ("error_report_heavy_tail", "heavy", "l_returnflag"), ("error_report_quantized", "collapsed", "l_linestatus")):
    query(f"WITH {_residuals(_flavour)}, {report_sql(_by)} SELECT {_by}, {_REPORT} FROM rep", _name)(_report_query(_flavour, _by))


@query(f"WITH {_residuals('heavy')}, {spread_sql('l_returnflag')} SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN v > med - 3*nmad AND v < med + 3*nmad THEN 1 ELSE 0 END) AS BIGINT) AS inliers FROM src JOIN nm USING (l_returnflag) GROUP BY l_returnflag")
def robust_normalize_counts(spark, d):
    rows = A.robust_normalize(residuals(spark, d, "heavy"), "v", ["l_returnflag"])
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("inlier").alias("inliers"))


@query(f"WITH {_residuals('collapsed')}, {spread_sql('l_linestatus')} SELECT l_linestatus, count(*) AS n, CAST(sum(CASE WHEN v > med - 3*nmad AND v < med + 3*nmad THEN 1 ELSE 0 END) AS BIGINT) AS inliers FROM src JOIN nm USING (l_linestatus) GROUP BY l_linestatus")
def robust_normalize_collapsed(spark, d):
    rows = A.robust_normalize(residuals(spark, d, "collapsed"), "v", ["l_linestatus"])
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_if("inlier").alias("inliers"))


@query("""WITH p AS (SELECT l_returnflag AS f, l_discount - 0.05e0 + CASE WHEN l_orderkey % 97 = 0 THEN 3e0 ELSE 0e0 END AS dx, l_tax - 0.04e0 AS dy FROM lineitem),
m AS (SELECT f, median(dx) AS mx, median(dy) AS my FROM p GROUP BY f),
s AS (SELECT f, any_value(mx) AS mx, any_value(my) AS my, 1.4826e0*median(abs(dx-mx)) AS sx, 1.4826e0*median(abs(dy-my)) AS sy FROM p JOIN m USING (f) GROUP BY f),
u AS (SELECT f, CASE WHEN (sx = 0 OR abs(dx-mx) <= 3*sx) AND (sy = 0 OR abs(dy-my) <= 3*sy) THEN sqrt(dx*dx+dy*dy) END AS h FROM p JOIN s USING (f))
SELECT f AS l_returnflag, count(*) AS n, count(h) AS n_used, round(quantile_cont(h, 0.9), 6) AS ce90 FROM u GROUP BY f""")
def ce90(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") - 0.05 + F.when(F.col("l_orderkey") % 97 == 0, 3.0).otherwise(0.0)).alias("dx"), (F.col("l_tax") - 0.04).alias("dy"))
    return rounded(A.ce90(rows, "dx", "dy", ["l_returnflag"]))


@query("""WITH src AS (SELECT o_orderpriority AS k, o_totalprice/1e6 AS v FROM orders), md AS (SELECT k, median(v) AS med FROM src GROUP BY k),
nm AS (SELECT k, count(v) AS n, any_value(med) AS median, 1.4826e0*median(abs(v-med)) AS nmad FROM src JOIN md USING (k) GROUP BY k),
t AS (SELECT *, abs(median) + 3*greatest(nmad, 1e-6) AS need FROM nm)
SELECT k AS o_orderpriority, n, round(median,6) AS median, round(nmad,6) AS nmad, CASE WHEN need <= 0.1e0 THEN 0.1e0 WHEN need <= 0.25e0 THEN 0.25e0 WHEN need <= 0.5e0 THEN 0.5e0 WHEN need <= 1e0 THEN 1e0 WHEN need <= 2.5e0 THEN 2.5e0 ELSE 5e0 END AS "limit" FROM t""")
def snap_clim_by_priority(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1e6).alias("v"))
    return rounded(A.snap_limit(rows, "v", ["o_orderpriority"]))


@query("""WITH b AS (SELECT l_returnflag, least(floor((least(greatest(l_discount*20 - 1, -0.9e0), 0.9e0) + 0.9e0) / (1.8e0/41)) + 1, 41) AS bin FROM lineitem)
SELECT l_returnflag, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY ALL""")
def residual_histogram(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") * 20 - 1).alias("v"))
    return rounded(A.histogram(rows, "v", 0.9, 41, ["l_returnflag"]))


@query("""WITH c AS (SELECT p_brand AS category, count(*) AS n FROM part GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS rk FROM c)
SELECT CASE WHEN rk <= 5 THEN category ELSE 'other' END AS category, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1""")
def top5_other(spark, d):
    return A.top_or_other(table(spark, d, "part"), "p_brand", 5)


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.005),6) AS q_5, round(quantile_cont(l_extendedprice, 0.02),6) AS q_20, round(quantile_cont(l_extendedprice, 0.98),6) AS q_980, round(quantile_cont(l_extendedprice, 0.995),6) AS q_995 FROM lineitem GROUP BY l_returnflag")
def percentile_stretch(spark, d):
    return rounded(A.stretch(table(spark, d, "lineitem"), "l_extendedprice", (0.005, 0.02, 0.98, 0.995), ["l_returnflag"]))


@query("SELECT round(min(l_tax - l_discount),6) AS min, round(median(l_tax - l_discount),6) AS median, round(max(l_tax - l_discount),6) AS max FROM lineitem")
def before_after_shift(spark, d):
    return rounded(A.before_after(table(spark, d, "lineitem"), "l_discount", "l_tax"))


@query("SELECT string_split(c_name, '#')[1] || '_' || CAST(c_nationkey AS VARCHAR) AS facility, round(avg(c_acctbal),6) AS x, round(avg(c_custkey),6) AS y FROM customer GROUP BY 1")
def facility_centroids(spark, d):
    rows = table(spark, d, "customer").withColumn("id", F.concat(F.split("c_name", "#")[0], F.lit("-"), F.col("c_nationkey"), F.lit("_"), F.col("c_custkey")))
    return rounded(A.centroids(rows, "id", "c_acctbal", "c_custkey").withColumn("facility", F.replace("facility", F.lit("-"), F.lit("_"))))


@query("SELECT p_type, round(avg(CASE WHEN p_size <> 0 OR p_retailprice <> 0 THEN 1e0 ELSE 0e0 END),6) AS valid_fraction FROM part GROUP BY p_type")
def valid_fraction(spark, d):
    return rounded(A.valid_fraction(table(spark, d, "part"), ("p_size", "p_retailprice"), ["p_type"], zero_is_missing=True))


# T: time


@query(f"SELECT DISTINCT l_shipdate, round({DECYEAR.format('l_shipdate')}, 9) AS y FROM lineitem")
def decyear_ship(spark, d):
    return table(spark, d, "lineitem").select("l_shipdate").distinct().select("l_shipdate", r(T.decyear(F.col("l_shipdate")), 9).alias("y"))


@query("SELECT event_id, true AS close FROM events")
def decyear_roundtrip(spark, d):
    back = T.decyear_inv(T.decyear(F.col("ts")))
    return table(spark, d, "events").select("event_id", (F.abs(F.unix_micros(back) - F.unix_micros(F.col("ts").cast("timestamp"))) < 1_000_000).alias("close"))


@query("""WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE 'x' END AS t FROM orders)
SELECT id, CASE length(t) WHEN 8 THEN CAST(try_strptime(t, '%Y%m%d') AS DATE) WHEN 6 THEN CAST(try_strptime(t || '01', '%Y%m%d') AS DATE) WHEN 4 THEN CAST(try_strptime(t || '0702', '%Y%m%d') AS DATE) END AS day FROM s""")
def mixed_date_parse(spark, d):
    m = F.col("o_orderkey") % 4
    text = F.when(m == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(m == 1, F.date_format("o_orderdate", "yyyyMM")).when(m == 2, F.date_format("o_orderdate", "yyyy")).otherwise("x")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.mixed_date(text).cast("date").alias("day"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(DATE '2022-12-01' + CAST(28 * floor(date_diff('day', DATE '2022-12-01', CAST(o_orderdate AS DATE)) / 28e0) AS INTEGER) AS DATE) AS cycle FROM orders")
def cycle_date(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().select("day", T.cycle_date(F.col("day")).alias("cycle"))


# F: text and JSON


@query("SELECT event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS ngs_k, CAST(NULL AS VARCHAR) AS ngs_absent FROM events")
def json_expand(spark, d):
    return table(spark, d, "events").select("event_id", *X.expand_json(F.col("props"), ("k", "absent")))


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k') = '0' THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def json_falsy(spark, d):
    return table(spark, d, "events").select("event_id", X.json_truthy(F.col("props"), "k").alias("k"))


_DATUMS = ["NAD 83(2011)", "NAD 83(1986)", "NAD 83(1992)", "NAD_83(HARN)", "NAD 83(FBN)", "NAD 83(NSRS2007)", "NAD 83(CORS96)", "WGS84", "NAD 83(2035)", "", "ITRF2016", "nad83(1994)"]
_RULES = " ".join(f"WHEN contains(s, '{t}') THEN '{c}'" for t, c in X.REALIZATIONS)
_PICK = "CASE " + " ".join(f"WHEN p_partkey % 13 = {i} THEN '{x}'" for i, x in enumerate(_DATUMS)) + " END"
_DATUM_SQL = f"""WITH t AS (SELECT p_partkey, {_PICK} AS datum FROM part), u AS (SELECT *, replace(replace(upper(datum), ' ', ''), '_', '') AS s FROM t),
c AS (SELECT p_partkey, datum, CASE WHEN starts_with(s, 'NAD83') THEN CASE {_RULES} END END AS crs FROM u)"""


def _datums(spark, d):
    pick = F.when(F.lit(False), F.lit(""))
    for i, x in enumerate(_DATUMS):
        pick = pick.when(F.col("p_partkey") % 13 == i, x)
    return table(spark, d, "part").select("p_partkey", pick.alias("datum"))


@query(_DATUM_SQL + " SELECT p_partkey, datum, crs FROM c")
def datum_rules(spark, d):
    return _datums(spark, d).withColumn("crs", X.datum_crs(F.col("datum")))


@query(_DATUM_SQL + " SELECT coalesce(datum, '(missing)') AS reason, count(*) AS n FROM c WHERE crs IS NULL GROUP BY 1")
def quarantine_report(spark, d):
    from ..sources.datasheets import quarantine

    return quarantine(_datums(spark, d).withColumns({"ref_frame": F.col("datum"), "horizontal_crs": X.datum_crs(F.col("datum"))}))[1]


@query("""WITH t AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'NAVD 88' WHEN 1 THEN 'ngvd29' WHEN 2 THEN ' ' ELSE n_name END AS v FROM nation), u AS (SELECT *, replace(upper(v), ' ', '') AS s FROM t)
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN contains(s, 'NGVD29') THEN 'EPSG:7968' WHEN contains(s, 'NAVD88') THEN 'EPSG:5703' END AS crs FROM u""")
def vert_datum_rules(spark, d):
    m = F.col("n_nationkey") % 4
    v = F.when(m == 0, "NAVD 88").when(m == 1, "ngvd29").when(m == 2, " ").otherwise(F.col("n_name"))
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), X.vertical_crs(v).alias("crs"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first, CASE WHEN contains(p_name, ' ') THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END AS rest FROM part")
def bounded_split(spark, d):
    p = F.split(F.trim("p_name"), r"\s+", 2)
    return table(spark, d, "part").select("p_partkey", F.get(p, F.lit(0)).alias("first"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("rest"))


@query("SELECT s_suppkey, round((CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END) * s_acctbal / 3600e0, 9) AS deg FROM supplier")
def arcsec_to_deg(spark, d):
    text = F.concat(F.col("s_acctbal").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "S").otherwise("N"))
    # a negative number of seconds keeps its own sign under the hemisphere's
    return table(spark, d, "supplier").select("s_suppkey", r(X.arcseconds(text), 9).alias("deg"))


@query("SELECT s_suppkey, trim(substr(s_name, 1, 8)) AS kind, CAST(substr(s_name, 10, 9) AS BIGINT) AS number FROM supplier")
def fixed_width_slices(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.trim(F.substring("s_name", 1, 8)).alias("kind"), F.substring("s_name", 10, 9).cast("long").alias("number"))


@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal / 5 END AS v FROM customer), u AS (SELECT *, pow(10e0, floor(log10(v))) AS p FROM t)
SELECT c_custkey, round(p * CASE WHEN v >= 5*p THEN 5 WHEN v >= 2*p THEN 2 ELSE 1 END, 6) AS nice FROM u""")
def nice_lengths(spark, d):
    return table(spark, d, "customer").select("c_custkey", r(X.nice_length(F.col("c_acctbal"))).alias("nice"))


@query("SELECT n_nationkey + 32600 AS code, CASE WHEN n_nationkey BETWEEN 1 AND 60 THEN 'UTM ' || CAST(n_nationkey AS VARCHAR) || 'N' END AS label FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation)")
def utm_labels(spark, d):
    code = F.col("n_nationkey").cast("long") + 32600
    return table(spark, d, "nation").select(code.alias("code"), X.utm_label(code).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 3, 5) THEN 'surveyed' ELSE 'estimated' END AS cls FROM part")
def position_class(spark, d):
    words = ["Military", "OWNER", None, " NGS ", "FAA-EST", "3rd party survey", ""]
    pick = F.get(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % 7).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.position_class(pick).alias("cls"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 5 IN (0, 3) THEN CAST(p_partkey % 360 AS DOUBLE) + 0.5e0 END AS azimuth FROM part")
def point_azimuth(spark, d):
    """From the column, else from the record's JSON, else missing."""
    k = F.col("p_partkey")
    own = F.when(k % 5 == 1, F.col("p_size").cast("double")).when(k % 5 == 3, F.lit(float("nan")))
    raw = F.when(k % 5 == 2, F.lit("no json")).when(k % 5 == 4, F.lit('{"true_az": "west"}')).otherwise(F.concat(F.lit('{"true_az": '), (k % 360 + 0.5).cast("string"), F.lit("}")))
    return table(spark, d, "part").select("p_partkey", X.azimuth(own, raw).alias("azimuth"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'g2018' WHEN 1 THEN 'g2012b' WHEN 2 THEN 'geoid99' END AS fragment FROM nation")
def geoid_fragments(spark, d):
    name = F.get(F.array(*[F.lit(x) for x in ("Geoid 18", "geoid12b", "GEOID99", "EGM96")], F.lit(None).cast("string")), (F.col("n_nationkey") % 5).cast("int"))
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), X.geoid_fragment(name).alias("fragment"))


# G: geodesy

_A, _E2 = G.GRS80
_HAV = "2*6371.0088e0*asin(sqrt(least(1e0, greatest(0e0, pow(sin(radians({3}-{1})/2),2) + cos(radians({1}))*cos(radians({3}))*pow(sin(radians({2}-{0})/2),2)))))"


@query(f"WITH {CONTROL} SELECT id, round({_HAV.format('x', 'y', '-115e0', '36e0')}, 6) AS km FROM control")
def haversine_pairs(spark, d):
    return control(spark, d).select("id", r(G.haversine_km(F.col("x"), F.col("y"), F.lit(-115.0), F.lit(36.0))).alias("km"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(((l_extendedprice + 180) % 360 + 360) % 360 - 180, 6) AS lon FROM (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, -l_extendedprice AS l_extendedprice FROM lineitem)")
def wrap_lon(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", (-F.col("l_extendedprice")).alias("v")).distinct()
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", r(G.wrap_lon(F.col("v"))).alias("lon"))


_TRIG = "sin(radians(x)) AS sl, cos(radians(x)) AS cl, sin(radians(y)) AS sp, cos(radians(y)) AS cp"
_ECEF = f"""t AS (SELECT *, {_TRIG} FROM control), u AS (SELECT *, {_A!r}e0 / sqrt(1 - {_E2!r}e0*sp*sp) AS nn FROM t),
ecef AS (SELECT *, (nn+height)*cp*cl AS ex, (nn+height)*cp*sl AS ey, (nn*(1-{_E2!r}e0)+height)*sp AS ez FROM u)"""


@query(f"WITH {CONTROL}, {_ECEF} SELECT id, round(ex,2) AS ex, round(ey,2) AS ey, round(ez,2) AS ez FROM ecef")
def geodetic_ecef(spark, d):
    x, y, z = G.geodetic_to_ecef(F.col("x"), F.col("y"), F.col("height"))
    return control(spark, d).select("id", r(x, 2).alias("ex"), r(y, 2).alias("ey"), r(z, 2).alias("ez"))


@query(f"WITH {CONTROL} SELECT id, true AS close FROM control")
def ecef_roundtrip(spark, d):
    lon, lat, h = G.ecef_to_geodetic(*G.geodetic_to_ecef(F.col("x"), F.col("y"), F.col("height")))
    close = (F.abs(lon - F.col("x")) < 1e-9) & (F.abs(lat - F.col("y")) < 1e-9) & (F.abs(h - F.col("height")) < 1e-4)
    return control(spark, d).select("id", close.alias("close"))


@query(f"WITH {CONTROL}, t AS (SELECT *, {_TRIG} FROM control) SELECT id, round(-sl*2 - sp*cl*3 + cp*cl*5, 6) AS dx, round(cl*2 - sp*sl*3 + cp*sl*5, 6) AS dy, round(cp*3 + sp*5, 6) AS dz, 2e0 AS e, 3e0 AS n, 5e0 AS u FROM t")
def enu_ecef(spark, d):
    two, three, five = F.lit(2.0), F.lit(3.0), F.lit(5.0)
    x, y, z = G.enu_to_ecef(two, three, five, F.col("x"), F.col("y"))
    e, n, u = G.ecef_to_enu(x, y, z, F.col("x"), F.col("y"))
    return control(spark, d).select("id", r(x).alias("dx"), r(y).alias("dy"), r(z).alias("dz"), r(e).alias("e"), r(n).alias("n"), r(u).alias("u"))


_DISP = f"""t AS (SELECT *, {_TRIG} FROM control), w AS (SELECT *, sqrt(1 - {_E2!r}e0*sp*sp) AS w FROM t), q AS (SELECT *, {_A!r}e0*(1-{_E2!r}e0)/(w*w*w) AS mm, {_A!r}e0/w AS nn FROM w)"""


@query(f"WITH {CONTROL}, {_DISP} SELECT id, round(x + degrees(100/((nn+height)*cp)),9) AS x, round(y + degrees(200/(mm+height)),9) AS y, round(height + 0.5,6) AS height FROM q")
def apply_displacement(spark, d):
    x, y, h = G.displaced(F.col("x"), F.col("y"), F.col("height"), F.lit(100.0), F.lit(200.0), F.lit(0.5))
    return control(spark, d).select("id", r(x, 9).alias("x"), r(y, 9).alias("y"), r(h).alias("height"))


_W = [f"({rate!r}e0 * pi() / 180 * 1e-6)" for rate in E.PLATES["NOAM"]]
_ROT = f"{_W[1]}*ez - {_W[2]}*ey AS rx, {_W[2]}*ex - {_W[0]}*ez AS ry, {_W[0]}*ey - {_W[1]}*ex AS rz"


@query(f"WITH {CONTROL}, {_ECEF}, v AS (SELECT *, {_ROT} FROM ecef) SELECT id, round(-sl*rx + cl*ry, 9) AS e, round(-sp*cl*rx - sp*sl*ry + cp*rz, 9) AS n, round(sqrt(pow(-sl*rx + cl*ry,2) + pow(-sp*cl*rx - sp*sl*ry + cp*rz,2)), 9) AS speed FROM v")
def euler_velocity(spark, d):
    e, n, _ = E.PlateMotion("NOAM", origin_bias=False).velocity_enu(F.col("x"), F.col("y"), F.col("height"))
    return control(spark, d).select("id", r(e, 9).alias("e"), r(n, 9).alias("n"), r(G.magnitude(e, n), 9).alias("speed"))


@query("SELECT s_suppkey, round((degrees(atan2(s_acctbal - 5000, s_nationkey - 12)) + 360) % 360, 6) AS azimuth FROM supplier")
def velocity_azimuth(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", r(G.azimuth(F.col("s_acctbal") - 5000, F.col("s_nationkey") - 12)).alias("azimuth"))


def _tm_sql() -> str:
    """Krueger's series from columns x, y and zone."""
    f = 1 - math.sqrt(1 - _E2)
    n = f / (2 - f)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600, 34729 * n**5 / 80640 - 3418889 * n**6 / 1995840, 212378941 * n**6 / 319334400,
    ]
    e, big = math.sqrt(_E2), _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    series = lambda f, g, o: " + ".join(f"{c:.17e} * {f}({2 * j}*xi) * {g}({2 * j}*eta)" for j, c in enumerate(alpha, 1)) + f" + {o}"
    return f"""z AS (SELECT *, CAST(floor((x + 180) / 6) AS BIGINT) AS zone FROM control), a AS (SELECT *, sin(radians(y)) AS s, radians(x - (zone * 6 - 177)) AS dl FROM z),
b AS (SELECT *, sinh(atanh(s) - {e!r}e0 * atanh({e!r}e0 * s)) AS t FROM a), c AS (SELECT *, atan2(t, cos(dl)) AS xi, asinh(sin(dl) / sqrt(t*t + cos(dl)*cos(dl))) AS eta FROM b),
tm AS (SELECT *, 5e5 + 0.9996e0 * {big!r}e0 * ({series("cos", "sinh", "eta")}) AS easting, 0.9996e0 * {big!r}e0 * ({series("sin", "cosh", "xi")}) AS northing FROM c)"""


@query(f"WITH {CONTROL}, {_tm_sql()} SELECT id, zone + 1 AS zone, round(easting, 3) AS easting, round(northing, 3) AS northing FROM tm")
def utm_projection(spark, d):
    """Every point in its own zone."""
    zone = F.floor((G.wrap_lon(F.col("x")) + 180) / 6)
    x, y = G.transverse_mercator(F.col("x"), F.col("y"), zone * 6 - 177)
    return control(spark, d).select("id", (zone + 1).cast("long").alias("zone"), r(x, 3).alias("easting"), r(y, 3).alias("northing"))


# E: epochs


def moving(spark, d):
    """Control with a velocity in two of three rows and no epoch in one of eleven."""
    v = F.when(F.col("id") % 3 != 0, (F.col("id") % 41 - 20) / 1000.0)
    rows = control(spark, d).withColumns({"vel_e": v, "vel_n": v / 2, "vel_u": v / 4, "transform_id": F.when(F.col("id") % 2 == 0, "a->b")})
    return rows.withColumn("coord_epoch", F.when(F.col("id") % 11 != 0, F.col("coord_epoch"))).withColumn("frame_epoch", F.lit(2010.0))


_MOVING = f"""{CONTROL}, mv AS (SELECT * REPLACE (CASE WHEN id % 11 <> 0 THEN coord_epoch END AS coord_epoch), CASE WHEN id % 3 <> 0 THEN (id % 41 - 20) / 1000e0 END AS v,
 CASE WHEN id % 2 = 0 THEN 'a->b' END AS tid FROM control), t AS (SELECT *, {_TRIG}, 2020e0 - coord_epoch AS dt FROM mv), w AS (SELECT *, sqrt(1 - {_E2!r}e0*sp*sp) AS w FROM t),
 q AS (SELECT *, {_A!r}e0*(1-{_E2!r}e0)/(w*w*w) AS mm, {_A!r}e0/w AS nn, v IS NOT NULL AND dt IS NOT NULL AS moved FROM w)"""


@query(f"""WITH {_MOVING} SELECT id, round(CASE WHEN moved THEN x + degrees(v*dt/((nn+height)*cp)) ELSE x END, 9) AS x, round(CASE WHEN moved THEN y + degrees(v/2*dt/(mm+height)) ELSE y END, 9) AS y,
 round(CASE WHEN moved THEN height + v/4*dt ELSE height END, 6) AS height, round(CASE WHEN moved THEN 2020e0 ELSE coord_epoch END, 9) AS coord_epoch,
 round(CASE WHEN moved THEN 0e0 ELSE abs(dt)*0.16e0 END, 6) AS epoch_residual_m,
 CASE WHEN tid IS NULL THEN '' ELSE tid || '+' END || CASE WHEN moved THEN 'prop:per_point->2020' ELSE 'prop:noop' END AS transform_id FROM q""")
def propagate_per_point(spark, d):
    got = E.propagate(moving(spark, d), 2020.0, "EPSG:9989", on_missing_epoch="skip")
    return got.select("id", r("x", 9).alias("x"), r("y", 9).alias("y"), r("height").alias("height"), r("coord_epoch", 9).alias("coord_epoch"), r("epoch_residual_m").alias("epoch_residual_m"), "transform_id")


@query(f"""WITH {_MOVING}, k AS (SELECT *, CASE WHEN dt IS NULL THEN 'prop:noop' WHEN v IS NOT NULL THEN 'prop:per_point->2020' ELSE 'prop:plate[ITRF2020-PMM:NOAM]->2020' END AS tag FROM q)
SELECT tag AS model, count(*) AS n, round(max(CASE WHEN dt IS NULL THEN NULL ELSE 0e0 END), 6) AS max_residual_m, CAST(sum(CASE WHEN dt IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unassessable FROM k GROUP BY tag""")
def propagate_ladder(spark, d):
    got = E.propagate(moving(spark, d), 2020.0, "EPSG:9989", E.PlateMotion("NOAM"), on_missing_epoch="skip")
    return rounded(E.propagation_report(got))


@query(f"WITH {_MOVING} SELECT CASE WHEN moved THEN 'prop:per_point->2020' ELSE 'prop:noop' END AS model, count(*) AS n, round(max(CASE WHEN moved THEN 0e0 ELSE abs(dt)*0.16e0 END),6) AS max_residual_m, CAST(sum(CASE WHEN NOT moved AND dt IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unassessable FROM q GROUP BY 1")
def epoch_report(spark, d):
    return rounded(E.propagation_report(E.propagate(moving(spark, d), 2020.0, "EPSG:9989", on_missing_epoch="skip")))


@query(f"WITH {_MOVING} SELECT id, coalesce(abs(2010e0 - coord_epoch) > 1e-6, false) AS unreduced FROM mv")
def epoch_qc(spark, d):
    return E.check_epochs(moving(spark, d)).select("id", "unreduced")


# V: velocity network


def stations(spark, d):
    k = F.col("s_suppkey")
    v = (F.col("s_acctbal") - 5000) / 1e6
    return table(spark, d, "supplier").select(k.alias("sta"), (F.lit(-125.0) + (k * 7919 % 58000) / 1000.0).alias("lon"), (F.lit(25.0) + (k * 1047 % 24000) / 1000.0).alias("lat"), v.alias("vel_e"), (v * 0.5).alias("vel_n"), (v * 0.25).alias("vel_u"))


def targets(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("pt"), (F.lit(-125.0) + (k * 5003 % 58000) / 1000.0).alias("lon"), (F.lit(25.0) + (k * 3001 % 24000) / 1000.0).alias("lat"))


_NET = f"""st AS (SELECT s_suppkey AS sta, -125e0 + (s_suppkey*7919 % 58000)/1000e0 AS slon, 25e0 + (s_suppkey*1047 % 24000)/1000e0 AS slat, (s_acctbal-5000)/1e6 AS v FROM supplier),
tg AS (SELECT c_custkey AS pt, -125e0 + (c_custkey*5003 % 58000)/1000e0 AS lon, 25e0 + (c_custkey*3001 % 24000)/1000e0 AS lat FROM customer),
pr AS (SELECT pt, sta, v, {_HAV.format("lon", "lat", "slon", "slat")} AS km FROM tg, st WHERE abs(lat - slat) < 4),
rk AS (SELECT *, row_number() OVER (PARTITION BY pt ORDER BY km, sta) AS k FROM pr WHERE km <= 400), top AS (SELECT * FROM rk WHERE k <= 15),
ag AS (SELECT pt, count(*) AS n, median(v) AS ve, median(v*0.5) AS vn, median(v*0.25) AS vu, sum(v/pow(greatest(km,0.001e0),2)) / sum(1/pow(greatest(km,0.001e0),2)) AS ie,
 coalesce(sqrt(pow(stddev_samp(v),2) + pow(stddev_samp(v*0.5),2)), 0e0) AS sh, min(km) AS nk, arg_min(sta, k) AS ns FROM top GROUP BY pt),
net AS (SELECT tg.pt, coalesce(n, 0) AS n, CASE WHEN coalesce(n,0) < 3 THEN 'low_density' WHEN n = 1 THEN 'single_station' WHEN sh*1000 > 4 THEN 'spread_warning' ELSE 'ok' END AS quality, ve, vn, vu, ie, sh, nk, ns FROM tg LEFT JOIN ag USING (pt))"""


@query(f"WITH {_NET} SELECT pt, round(CASE WHEN quality <> 'low_density' THEN ve END, 12) AS vel_e, round(CASE WHEN quality <> 'low_density' THEN vn END, 12) AS vel_n, round(CASE WHEN quality <> 'low_density' THEN vu END, 12) AS vel_u, n AS n_stations, ns AS nearest_sta, round(nk, 6) AS nearest_km, quality FROM net")
def knn_velocity_median(spark, d):
    got = N.interpolate_velocity(targets(spark, d), stations(spark, d), "pt", "median", 400.0)
    return got.select("pt", r("vel_e", 12).alias("vel_e"), r("vel_n", 12).alias("vel_n"), r("vel_u", 12).alias("vel_u"), "n_stations", "nearest_sta", r("nearest_km").alias("nearest_km"), "quality")


@query(f"WITH {_NET} SELECT pt, round(CASE WHEN quality <> 'low_density' THEN ie END, 9) AS vel_e, round(CASE WHEN quality <> 'low_density' THEN sh END, 9) AS spread_h FROM net")
def knn_velocity_idw(spark, d):
    got = N.interpolate_velocity(targets(spark, d), stations(spark, d), "pt", "idw", 400.0)
    return got.select("pt", r("vel_e", 9).alias("vel_e"), r("spread_h", 9).alias("spread_h"))


@query(f"WITH {_NET} SELECT quality, count(*) AS n_total, count(CASE WHEN quality <> 'low_density' THEN ve END) AS n_filled FROM net GROUP BY quality")
def knn_quality_counts(spark, d):
    rows = targets(spark, d).select(F.col("pt").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return N.fill_report(N.fill_velocities(rows, stations(spark, d), "id", "quality", radius_km=400.0), "quality")


@query(f"WITH {_NET} SELECT pt AS id, round(CASE WHEN quality <> 'low_density' THEN ve END, 9) AS vel_e, quality FROM net")
def fill_velocity(spark, d):
    rows = targets(spark, d).select(F.col("pt").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit(9.0).alias("vel_e"))
    return N.fill_velocities(rows, stations(spark, d), "id", "quality", radius_km=400.0).select("id", r("vel_e", 9).alias("vel_e"), "quality")


@query("""WITH s AS (SELECT s_suppkey AS sta, -125e0 + (s_suppkey*7919 % 58000)/1000e0 AS lon, 25e0 + (s_suppkey*1047 % 24000)/1000e0 AS lat FROM supplier),
d AS (SELECT *, pow(((lon + 115 + 180) % 360 - 180) * cos(radians(36e0)), 2) + pow(lat - 36, 2) AS d2 FROM s) SELECT sta FROM d ORDER BY d2, lon, lat LIMIT 10""")
def nearest_ten(spark, d):
    """A top-k report."""
    return S.nearest_to(stations(spark, d), -115.0, 36.0, 10).select("sta")


@query("""WITH s AS (SELECT s_suppkey AS sta, -125e0 + (s_suppkey*7919 % 58000)/1000e0 AS lon, 25e0 + (s_suppkey*1047 % 24000)/1000e0 AS lat FROM supplier)
SELECT sta, CASE WHEN lon BETWEEN -110 AND -90 AND lat BETWEEN 30 AND 40 THEN 'inside' WHEN lon BETWEEN -110 - 200/111e0/cos(radians(35e0)) AND -90 + 200/111e0/cos(radians(35e0)) AND lat BETWEEN 30 - 200/111e0 AND 40 + 200/111e0 THEN 'buffer' ELSE 'outside' END AS place FROM s""")
def station_places(spark, d):
    return S.classify_stations(stations(spark, d), (-110.0, 30.0, -90.0, 40.0), 200.0).select("sta", "place")


# W: windows over series


def series(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("sta"), F.col("ts").cast("timestamp").alias("date"), "event_id", F.col("value").alias("height"), ((F.col("event_id") * 37) % 360).cast("double").alias("longitude"), (F.col("value") / 10).alias("latitude"), T.decyear(F.col("ts")).alias("decyear"))


@query("SELECT user_id AS sta, count(*) AS n, round(median(value), 6) AS height FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-15' - INTERVAL 30 DAY AND TIMESTAMP '2024-01-15' + INTERVAL 30 DAY GROUP BY user_id")
def window_epoch_30d(spark, d):
    rows, _ = select_window(series(spark, d), epoch=2024 + 14 / 366)
    return rounded(rows.groupBy("sta").agg(F.count("*").alias("n"), F.median("height").alias("height")))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value / 10, (event_id * 37) % 360) AS rn FROM events) SELECT user_id AS sta, count(*) AS n, round(median(value), 6) AS height FROM k WHERE rn <= 30 GROUP BY user_id")
def window_last_n(spark, d):
    rows, _ = select_window(series(spark, d), last=30)
    return rounded(rows.groupBy("sta").agg(F.count("*").alias("n"), F.median("height").alias("height")))


@query("SELECT user_id AS sta, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY user_id")
def window_span(spark, d):
    rows, _ = select_window(series(spark, d), span=(2024 + 4 / 366, 2024 + 19 / 366))
    return rows.groupBy("sta").agg(F.count("*").alias("n"))


_LON = "CASE WHEN max(lon) - min(lon) > 180 THEN (median((lon + 360) % 360) + 180) % 360 - 180 ELSE median(lon) END"


@query(f"""WITH e AS (SELECT user_id AS sta, ts, value, {DECYEAR.format("ts")} AS y, ((CAST((event_id*37) % 360 AS DOUBLE) + 180) % 360) - 180 AS lon FROM events),
m AS (SELECT sta, median(y) AS mid, median(value) AS height, median(value/10) AS lat, {_LON} AS lon, count(*) AS n, min(ts) AS b, max(ts) AS e FROM e GROUP BY sta),
o AS (SELECT sta, ts, row_number() OVER (PARTITION BY sta ORDER BY round(abs(y - mid), 12), ts) AS rn FROM e JOIN m USING (sta))
SELECT sta, round(lat,6) AS lat, round(lon,6) AS lon, round(height,6) AS height, round(mid,9) AS coord_epoch, n AS n_solutions_used, b AS first_used, e AS last_used, ts AS measurement_datetime FROM m JOIN o USING (sta) WHERE rn = 1""")
def window_position(spark, d):
    rows = series(spark, d).withColumn("longitude", G.wrap_lon(F.col("longitude")))
    rows = rows.withColumns({c: F.lit(0.0) for c in ("sig_e", "sig_n", "sig_u", "ant")})
    got = positions(rows)
    time = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_used", "last_used", "measurement_datetime")]
    return got.select("sta", r("lat").alias("lat"), r("lon").alias("lon"), r("height").alias("height"), r("coord_epoch", 9).alias("coord_epoch"), "n_solutions_used", *time)


@query(f"""WITH s AS (SELECT user_id AS sta, ((CAST((event_id*37) % 360 AS DOUBLE) + 180) % 360) - 180 AS lon FROM events) SELECT sta, round({_LON}, 6) AS lon FROM s GROUP BY sta""")
def median_lon_antimeridian(spark, d):
    rows = series(spark, d).withColumn("lon", G.wrap_lon(F.col("longitude")))
    return rows.groupBy("sta").agg(r(median_lon(F.col("lon"))).alias("lon"))


@query("WITH s AS (SELECT user_id AS sta, min(ts) AS b, max(ts) AS e FROM events GROUP BY 1) SELECT sta, b <= TIMESTAMP '2024-01-02' + INTERVAL 1 DAY AND e >= TIMESTAMP '2024-01-01' - INTERVAL 1 DAY AS early, b <= TIMESTAMP '2024-01-31' + INTERVAL 1 DAY AND e >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY AS late FROM s")
def temporal_overlap(spark, d):
    spans = series(spark, d).groupBy("sta").agg(F.min("date").alias("b"), F.max("date").alias("e"))
    at = lambda text: F.to_timestamp(F.lit(f"2024-01-{text} 00:00:00"))
    return spans.select("sta", S.overlaps(F.col("b"), F.col("e"), at("01"), at("02"), 1).alias("early"), S.overlaps(F.col("b"), F.col("e"), at("30"), at("31"), 1).alias("late"))


# R: rasters

COLUMNS = 50
#: The raster's height over the control box and a margin.  With the margin, weights aren't short decimals, so sums in another order don't
#: end on the two sides of a rounding tie.
SPAN = 24.037
_ROWS = f"(SELECT max(p_partkey) // {COLUMNS} + 1 FROM part)"


def raster(spark, d) -> tuple[DataFrame, R.Grid]:
    """A raster of part prices, as high as the table makes it; one price in 23 stands for no data."""
    part = table(spark, d, "part")
    rows = (part.agg(F.max("p_partkey")).first()[0] or 0) // COLUMNS + 1
    k = F.col("p_partkey")
    cells = part.select(F.expr(f"p_partkey div {COLUMNS}").alias("row"), (k % COLUMNS).alias("col"), F.when(k % 23 == 0, -9999.0).otherwise(F.col("p_retailprice") + k * 7 % 31).alias("z"))
    return cells, R.Grid(-125.0, 49.0, 1.0, -(SPAN / rows), rows, COLUMNS, -9999.0)


_STEP = f"({SPAN}e0/{_ROWS})"
_PART_CELLS = f"cl AS (SELECT p_partkey // {COLUMNS} AS r, p_partkey % {COLUMNS} AS c, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_retailprice + p_partkey*7 % 31 END AS z FROM part)"
_CELLS = f"""{_PART_CELLS}, {CONTROL}, fr AS (SELECT *, (x + 125e0)/1e0 AS pc, (y - 49e0)/(-{_STEP}) AS pr FROM control)"""


_NEAREST = f"{_CELLS}, smp AS (SELECT fr.*, z AS h FROM fr LEFT JOIN cl ON c = floor(pc) AND r = floor(pr) AND pc >= 0 AND pc < 50 AND pr >= 0 AND pr < {_ROWS})"
_LINEAR = f"""{_CELLS}, ce AS (SELECT *, pc - 0.5e0 AS qc, pr - 0.5e0 AS qr FROM fr), ba AS (SELECT *, least(floor(qc), 48) AS c0, least(floor(qr), greatest({_ROWS} - 2, 0)) AS r0 FROM ce),
fo AS (SELECT id, (1 - abs(qc - (c0+j)))*(1 - abs(qr - (r0+i))) AS w, r0+i AS rr, c0+j AS cc FROM ba, (VALUES (0,0),(0,1),(1,0),(1,1)) AS o(i,j) WHERE qc BETWEEN 0 AND 49 AND qr BETWEEN 0 AND {_ROWS} - 1),
ag AS (SELECT id, CASE WHEN count(z) = 4 THEN sum(w*z) END AS h FROM fo LEFT JOIN cl ON c = cc AND r = rr GROUP BY id), smp AS (SELECT control.*, h FROM control LEFT JOIN ag USING (id))"""


@query(f"WITH {_NEAREST} SELECT id, round(h,6) AS h FROM smp")
def raster_nearest(spark, d):
    return R.sample(control(spark, d), *raster(spark, d), method="nearest").select("id", r("h").alias("h"))


@query(f"WITH {_LINEAR} SELECT id, round(h,6) AS h FROM smp")
def raster_linear(spark, d):
    return R.sample(control(spark, d), *raster(spark, d)).select("id", r("h").alias("h"))


@query(f"WITH {_LINEAR} SELECT source, count(*) AS n, count(h) AS n_valid FROM smp GROUP BY source")
def raster_nodata_gap(spark, d):
    return R.sample(control(spark, d), *raster(spark, d)).groupBy("source").agg(F.count("*").alias("n"), F.count("h").alias("n_valid"))


@query(f"""WITH {_CELLS}, hit AS (SELECT id, z FROM fr JOIN cl ON pow(-125e0 + (c + 0.5e0) - x, 2) + pow(49e0 - (r + 0.5e0)*{_STEP} - y, 2) <= 1.44e0 WHERE pc >= 0 AND pc < 50 AND pr >= 0 AND pr < {_ROWS} AND z IS NOT NULL),
m AS (SELECT id, median(z) AS med, count(*) AS n FROM hit GROUP BY id), s AS (SELECT id, any_value(med) AS h, 1.4826e0*median(abs(z-med)) AS h_nmad, any_value(n) AS h_n FROM hit JOIN m USING (id) GROUP BY id)
SELECT control.id, round(h,6) AS h, round(h_nmad,6) AS h_nmad, coalesce(h_n, 0) AS h_n FROM control LEFT JOIN s USING (id)""")
def raster_radius(spark, d):
    return rounded(R.sample(control(spark, d), *raster(spark, d), metres=1.2).select("id", "h", "h_nmad", "h_n"))


def _near(side: str) -> str:
    return f"n{side}.z"


_SLOPE = "CASE WHEN {a}.r IS NOT NULL AND {b}.r IS NOT NULL THEN ({a}.z - {b}.z)/(2*{s}) WHEN {a}.r IS NOT NULL THEN ({a}.z - o.z)/{s} WHEN {b}.r IS NOT NULL THEN (o.z - {b}.z)/{s} ELSE o.z*0 END"


_SHADE = f"""WITH {_PART_CELLS},
g AS (SELECT o.r, o.c, o.z, {_SLOPE.format(a='e', b='w', s='1e0')} AS ge, {_SLOPE.format(a='s', b='n', s=_STEP)} AS gs FROM cl o LEFT JOIN cl e ON e.r = o.r AND e.c = o.c + 1 LEFT JOIN cl w ON w.r = o.r AND w.c = o.c - 1
 LEFT JOIN cl s ON s.r = o.r + 1 AND s.c = o.c LEFT JOIN cl n ON n.r = o.r - 1 AND n.c = o.c),
t AS (SELECT r, c, z, atan(sqrt(ge*ge+gs*gs)) AS sl, atan2(gs, -ge) AS asp, ge, gs FROM g)
SELECT r AS row, c AS col, round(CASE WHEN z IS NOT NULL AND ge IS NOT NULL AND gs IS NOT NULL THEN SHADE END, 6) AS shade FROM t"""


def _lamp(azimuth: float) -> str:
    return f"least(greatest(cos(radians(45e0))*cos(sl) + sin(radians(45e0))*sin(sl)*cos(radians({(450 - azimuth) % 360}e0) - asp), 0e0), 1e0)"


def _shaded(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), r("shade").alias("shade"))


@query(_SHADE.replace("SHADE", _lamp(315)))
def hillshade(spark, d):
    return _shaded(R.hillshade(*raster(spark, d)))


@query(_SHADE.replace("SHADE", f"({' + '.join(map(_lamp, R.LAMPS))}) / {len(R.LAMPS)}"))
def hillshade_multidirectional(spark, d):
    return _shaded(R.hillshade(*raster(spark, d), R.LAMPS))


def _products(spark, d):
    high, grid = raster(spark, d)
    low = high.withColumn("z", F.when(F.col("z") > -9999, F.col("z") - 100).otherwise(F.col("z")))
    return {"DSM": (high, grid), "DTM": (low, grid)}


@query(f"WITH {_LINEAR} SELECT id, round(h,6) AS \"h_DSM\", round(h - height,6) AS \"dh_DSM_before\", round(h - 100,6) AS \"h_DTM\", round(h - 100 - height,6) AS \"dh_DTM_before\" FROM smp")
def sample_products(spark, d):
    got = R.sample_products(control(spark, d), _products(spark, d), height="height")
    return rounded(got.select("id", "h_DSM", "dh_DSM_before", "h_DTM", "dh_DTM_before"))


_SEGMENTS = """ms AS (SELECT s.*, seg.segment, seg.dsm, seg.dtm FROM smp s, (VALUES ('3DEP NVA', true, true), ('3DEP VVA', false, true), ('GNSS/OPUS', true, true), ('NGS monument', true, true), ('ALL', true, true)) AS seg(segment, dsm, dtm)
 WHERE seg.segment = 'ALL' OR (seg.segment = '3DEP NVA' AND source = '3dep' AND point_type = 'NVA') OR (seg.segment = '3DEP VVA' AND source = '3dep' AND point_type = 'VVA') OR (seg.segment = 'GNSS/OPUS' AND source = 'opus') OR (seg.segment = 'NGS monument' AND source = 'ngs')),
src AS (SELECT product, segment, CASE product WHEN 'DSM' THEN h - height ELSE h - 100 - height END AS v FROM ms, (VALUES ('DSM'), ('DTM')) AS p(product))"""
_SUMMARY = f"""{report_sql("product, segment")}, cnt AS (SELECT product, segment, count(*) AS rows FROM src GROUP BY ALL)
SELECT product, segment, rows AS n, n AS n_valid, n_outliers AS n_out, round(median,8) AS median_m, round(nmad,8) AS nmad_m, round(mean,4) AS mean_m, round(std,4) AS std_m, round(rmse,4) AS rmse_m,
 round(le90,8) AS le90_m, round(le95,8) AS le95_m, CAST(NULL AS DOUBLE) AS xform_acc_m, NOT (product = 'DSM' AND segment = '3DEP VVA') AS applies FROM rep JOIN cnt USING (product, segment)"""


@query(f"WITH {_LINEAR}, {_SEGMENTS}, {_SUMMARY}")
def assess_end_to_end(spark, d):
    """Flagship: control, sampled in two products, residuals by segment."""
    got = R.sample_products(control(spark, d), _products(spark, d), height="height")
    fine = ("median_m", "nmad_m", "le90_m", "le95_m")  # order statistics: no summation, so more digits agree
    out = A.summarize(got, ["DSM", "DTM"])
    return out.select(*[r(c, 8 if c in fine else 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# rows whose ids repeat: what a row gets depends on its own place alone


def repeated(rows: DataFrame) -> DataFrame:
    """Each id for many rows, and every row told apart by the one it had; every 7th twice."""
    again = F.explode(F.when(F.col("was") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.withColumnRenamed("id", "was").withColumns({"id": F.col("was") % 10, "copy": again}).drop("copy")


_TWICE = "JOIN (VALUES (1), (2)) AS tw(k) ON k = 1 OR id % 7 = 0"


@query(f"WITH {_LINEAR} SELECT id % 10 AS id, id AS was, round(h, 6) AS h FROM smp {_TWICE}")
def raster_linear_repeated_ids(spark, d):
    return R.sample(repeated(control(spark, d)), *raster(spark, d)).select("id", "was", r("h").alias("h"))


@query(SQL["raster_radius"].replace("SELECT control.id,", "SELECT control.id % 10 AS id, control.id AS was,") + f" {_TWICE.replace('id %', 'control.id %')}")
def raster_radius_repeated_ids(spark, d):
    return rounded(R.sample(repeated(control(spark, d)), *raster(spark, d), metres=1.2).select("id", "was", "h", "h_nmad", "h_n"))


@query(SQL["fill_velocity"].replace("SELECT pt AS id,", "SELECT pt % 10 AS id, pt AS was,") + f" {_TWICE.replace('id %', 'pt %')}")
def fill_velocity_repeated_ids(spark, d):
    rows = targets(spark, d).select(F.col("pt").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return N.fill_velocities(repeated(rows), stations(spark, d), "id", "quality", radius_km=400.0).select("id", "was", r("vel_e", 9).alias("vel_e"), "quality")


_ONE_PRODUCT = _SEGMENTS.replace("smp s", "control s").replace("CASE product WHEN 'DSM' THEN h - height ELSE h - 100 - height END", "height").replace("(VALUES ('DSM'), ('DTM'))", "(VALUES ('DSM'))")


@query(f"""WITH {CONTROL}, {_ONE_PRODUCT}, {report_sql("product, segment")}
SELECT product, segment, n, n AS n_valid, n_outliers AS n_out, round(median,6) AS median_m FROM rep""")
def segment_summary(spark, d):
    rows = control(spark, d).withColumn("dh_DSM_before", F.col("height"))
    return rounded(A.summarize(rows, ["DSM"]).select("product", "segment", "n", "n_valid", "n_out", "median_m"))


# P: classes of control


def described(spark, d):
    """Control with records of monuments and runways in ``raw``."""
    k = F.col("id")
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), ((k / n).cast("long") % len(words)).cast("int"))
    raw = F.to_json(F.struct(pick(["ADJUSTED", "SCALED"], 2).alias("posSource"), pick(["GPS OBS", "LEVELED", "READJUSTED", None], 3).alias("vertSource"), pick(["surveyed", "estimated"], 5).alias("pos_class")))
    return control(spark, d).withColumns({"raw": raw, "ref_frame": pick(["NAD 83(2011)", "NAD 83(1992)", None], 7)})


_DESCRIBED = f"""{CONTROL}, ds AS (SELECT *, (['ADJUSTED','SCALED'])[(id // 2) % 2 + 1] AS ps, (['GPS OBS','LEVELED','READJUSTED',NULL])[(id // 3) % 4 + 1] AS vs, (['surveyed','estimated'])[(id // 5) % 2 + 1] AS pc,
 (['NAD 83(2011)','NAD 83(1992)',NULL])[(id // 7) % 3 + 1] AS rf FROM control),
be AS (SELECT *, source = 'ngs' AND ps = 'ADJUSTED' AND (coalesce(replace(rf, ' ', '') = 'NAD83(2011)', false) OR coalesce(vs IN ('GPS OBS', 'ADJUSTED', 'READJUSTED'), false)) AS best FROM ds)"""


@query(f"WITH {_DESCRIBED} SELECT id, best FROM be")
def best_monument(spark, d):
    return described(spark, d).select("id", Y.best_monument().alias("best"))


_FAMILIES = f"""{_DESCRIBED}, fam AS (SELECT id, height, f.product, f.family, f.subclass FROM be, (VALUES ('DSM','3dep','NVA'), ('DTM','3dep','NVA'), ('DTM','3dep','VVA'), ('DSM','gnss','GNSS/OPUS'), ('DTM','gnss','GNSS/OPUS'),
 ('DSM','ngs_best','NGS best'), ('DTM','ngs_best','NGS best'), ('DSM','faa','Surveyed'), ('DTM','faa','Surveyed'), ('DSM','faa','Estimated'), ('DTM','faa','Estimated')) AS f(product, family, subclass)
 WHERE CASE f.subclass WHEN 'NVA' THEN source = '3dep' AND point_type = 'NVA' WHEN 'VVA' THEN source = '3dep' AND point_type = 'VVA' WHEN 'GNSS/OPUS' THEN source = 'opus' WHEN 'NGS best' THEN best
 WHEN 'Surveyed' THEN source = 'faa' AND pc = 'surveyed' ELSE source = 'faa' AND pc = 'estimated' END)"""


@query(f"WITH {_FAMILIES} SELECT id, product, family, subclass FROM fam")
def families(spark, d):
    return Y.with_families(described(spark, d), ["DSM", "DTM"]).select("id", "product", "family", "subclass")


@query(f"""WITH {_FAMILIES}, src AS (SELECT subclass, height AS v FROM fam WHERE product = 'DTM'), {spread_sql("subclass")}, g AS (SELECT subclass, v FROM src JOIN nm USING (subclass) WHERE nmad = 0 OR abs(v - med) < 1 * nmad),
m2 AS (SELECT subclass, median(v) AS med FROM g GROUP BY subclass) SELECT subclass, count(*) AS n, round(any_value(med), 6) AS median, round(1.4826e0 * median(abs(v - med)), 6) AS nmad FROM g JOIN m2 USING (subclass) GROUP BY subclass""")
def gate_then_describe(spark, d):
    rows = Y.with_families(described(spark, d), ["DTM"]).select("subclass", "height")
    return rounded(Y.gate_then_describe(rows, "height", ["subclass"], 1.0))


@query(f"""WITH {CONTROL}, k AS (SELECT id, CASE source WHEN 'ngs' THEN 0 WHEN '3dep' THEN 1 ELSE 2 END AS class_rank FROM control)
SELECT id, CAST(class_rank AS BIGINT) AS class_rank, CAST((row_number() OVER (PARTITION BY class_rank ORDER BY CAST(id AS VARCHAR)) - 1) // 24 AS BIGINT) AS page FROM k""")
def review_pages(spark, d):
    return rounded(Y.pages(control(spark, d), "id", 24, {"ngs": 0, "3dep": 1}, "source").select("id", "class_rank", "page"))


@query(f"WITH {CONTROL} SELECT id, CASE id % 3 WHEN 0 THEN 'a->b' WHEN 1 THEN 'gone' END AS transform_id, CASE WHEN id % 3 = 0 THEN 0.015e0 END AS accuracy_m FROM control")
def operation_records(spark, d):
    rows = control(spark, d).withColumn("transform_id", F.when(F.col("id") % 3 == 0, "a->b").when(F.col("id") % 3 == 1, "gone"))
    records = spark.createDataFrame([("a->b", 0.015), ("b->c", None)], "transform_id string, accuracy_m double")
    return Y.with_operations(rows, records).select("id", "transform_id", "accuracy_m")


# J, D: spatial predicates and sets

_BOX = (-110.0, 30.0, -90.0, 40.0)
_QUAD = [("A", 0, 0, -118.3, 31.1), ("A", 0, 1, -96.2, 28.7), ("A", 0, 2, -92.1, 44.9), ("A", 0, 3, -115.7, 42.2), ("B", 0, 0, -100.4, 30.3), ("B", 0, 1, -80.6, 33.8), ("B", 0, 2, -86.9, 47.1)]


def _edges(spark):
    return S.edges(spark.createDataFrame(_QUAD, "poly_id string, ring int, seq int, x double, y double"))


def _edge_values() -> str:
    out = []
    for p in "AB":
        v = [q for q in _QUAD if q[0] == p]
        out += [f"('{p}', {a[3]}e0, {a[4]}e0, {b[3]}e0, {b[4]}e0)" for a, b in zip(v, v[1:] + v[:1], strict=True)]
    return ", ".join(out)


_CAST = f"{CONTROL}, ed(p, x1, y1, x2, y2) AS (VALUES {_edge_values()}), hit AS (SELECT id, p FROM control, ed GROUP BY id, p HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2-x1)*(y-y1)/(y2-y1) + x1 THEN 1 ELSE 0 END) % 2 = 1)"


@query(f"WITH {CONTROL} SELECT id FROM control WHERE x BETWEEN -110 AND -90 AND y BETWEEN 30 AND 40")
def bbox_clip(spark, d):
    return control(spark, d).where(S.in_box(F.col("x"), F.col("y"), _BOX)).select("id")


@query(f"WITH {_CAST} SELECT DISTINCT id FROM hit")
def polygon_clip(spark, d):
    return S.clip(control(spark, d), _edges(spark)).select("id")


@query(f"WITH {_CAST}, f AS (SELECT id, min(p) AS plate FROM hit GROUP BY id) SELECT control.id, plate FROM control LEFT JOIN f USING (id)")
def plate_assign(spark, d):
    return S.assign_polygon(control(spark, d), _edges(spark)).select("id", "plate")


@query(f"WITH {_CAST}, f AS (SELECT id, min(p) AS plate FROM hit GROUP BY id) SELECT control.id % 10 AS id, control.id AS was, plate FROM control LEFT JOIN f USING (id) {_TWICE}")
def plate_assign_repeated_ids(spark, d):
    return S.assign_polygon(repeated(control(spark, d)), _edges(spark)).select("id", "was", "plate")


@query(f"WITH {CONTROL} SELECT source, count(*) AS n, round(sum(height),3) AS h FROM control GROUP BY source")
def union_sources(spark, d):
    rows = control(spark, d)
    parts = [rows.where(F.col("source") == s) for s in ("3dep", "opus", "ngs", "faa")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source").agg(F.count("*").alias("n"), r(F.sum("height"), 3).alias("h"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) SELECT user_id, event_id FROM k WHERE rn = 1")
def dedupe_first_seen(spark, d):
    return dedupe_first(table(spark, d, "events"), F.col("user_id").cast("string"), "event_id").select("user_id", "event_id")


@query("SELECT o_orderstatus, count(DISTINCT o_orderpriority) = 1 AS uniform FROM orders GROUP BY o_orderstatus")
def crs_promotion(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg((F.count_distinct("o_orderpriority") == 1).alias("uniform"))


def _helmert_sql(epoch: str) -> str:
    """tr: control moved from ITRF2014 to NAD83(2011) by the 14 parameters at 2010.0, as lon, lat, up."""
    p = (1.00530, -1.90921, -0.54157, 26.78138, -0.42027, 10.93206, 0.36891)
    v = (0.00079, -0.00060, -0.00144, 0.06667, -0.75744, -0.05133, -0.07201)
    mas = math.pi / 180 / 3600 / 1000
    scale = (1, 1, 1, mas, mas, mas, 1e-9)
    t = ", ".join(f"({a!r}e0 + {b!r}e0 * ({epoch} - 2010)) * {k:.17e} AS t{i}" for i, (a, b, k) in enumerate(zip(p, v, scale, strict=True)))
    b = _A * math.sqrt(1 - _E2)
    second = (_A * _A - b * b) / (b * b)
    return f"""{_ECEF}, h0 AS (SELECT *, {t} FROM ecef),
h1 AS (SELECT *, t0 + (1+t6)*ex - t5*ey + t4*ez AS hx, t1 + t5*ex + (1+t6)*ey - t3*ez AS hy, t2 - t4*ex + t3*ey + (1+t6)*ez AS hz FROM h0), h2 AS (SELECT *, sqrt(hx*hx + hy*hy) AS hp FROM h1),
h3 AS (SELECT *, atan2(hz*{_A!r}e0, hp*{b!r}e0) AS be FROM h2), h4 AS (SELECT *, sin(atan2(hz + {second * b!r}e0*pow(sin(be),3), hp - {_E2 * _A!r}e0*pow(cos(be),3))) AS hs FROM h3),
h5 AS (SELECT *, atan2(hz + {_E2 * _A!r}e0/sqrt(1 - {_E2!r}e0*hs*hs)*hs, hp) AS ph FROM h4),
tr AS (SELECT *, degrees(atan2(hy, hx)) AS lon, degrees(ph) AS lat, hp*cos(ph) + hz*sin(ph) - {_A!r}e0*sqrt(1 - {_E2!r}e0*sin(ph)*sin(ph)) AS up FROM h5)"""


@query(f"""WITH {CONTROL}, {_helmert_sql("coord_epoch")} SELECT id, round(CASE WHEN id % 5 IN (1, 2) THEN lon ELSE x END, 8) AS x, round(CASE WHEN id % 5 IN (1, 2) THEN lat ELSE y END, 8) AS y, round(height, 6) AS height,
 CASE WHEN id % 5 = 1 THEN 'EPSG:7912->EPSG:6318' WHEN id % 5 = 2 THEN 'IGS14->EPSG:6318' ELSE 'identity' END AS transform_id FROM tr""")
def land_datums(spark, d):
    """Rows of a dynamic frame, of its alias, of the target and of none, landed in one frame; heights stay."""
    m = F.col("id") % 5
    crs = F.when(m == 1, "EPSG:7912").when(m == 2, "IGS14").when(m == 3, "EPSG:6318")
    rows = control(spark, d).withColumns({"horizontal_crs": crs, "transform_id": F.lit(None).cast("string")})
    return land(rows).select("id", r("x", 8).alias("x"), r("y", 8).alias("y"), r("height").alias("height"), "transform_id")


@query(f"WITH {CONTROL}, {_helmert_sql('coord_epoch')} SELECT id, round(lon, 8) AS x, round(lat, 8) AS y, round(up, 3) AS height FROM tr")
def transform_frames(spark, d):
    rows = control(spark, d).withColumn("transform_id", F.lit(None).cast("string"))
    return transform_points(rows, "EPSG:7912", "EPSG:6319", "coord_epoch").select("id", r("x", 8).alias("x"), r("y", 8).alias("y"), r("height", 3).alias("height"))


@query(f"WITH {CONTROL}, {_helmert_sql('2010e0')} SELECT id, round(lon, 8) AS x, round(up, 3) AS h_ell, 0.015e0 AS xform_acc_m FROM tr")
def transform_to_product(spark, d):
    """Control that declares its frame, into a product's 3-D frame at an epoch."""
    rows = control(spark, d).withColumns({"transform_id": F.lit(None).cast("string"), "frame_crs": F.lit("EPSG:7912")})
    return transform_control(rows, "EPSG:7912", "EPSG:6319", 2010.0)[0].select("id", r("x", 8).alias("x"), r("h_ell", 3).alias("h_ell"), "xform_acc_m")


FLAGSHIP = QUERIES["assess_end_to_end"]
