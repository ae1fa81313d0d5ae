"""Queries over positions, segments, passes, visits and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspan.functions import geo, times
from fieldspan.model import Settings
from fieldspan.operators import metrics, motion, results
from fieldspan.plans.oracles import over
from fieldspan.plans.tables import Tables

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def r6(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


@query("o04_safe_numbers", "SELECT doc_id, TRY_CAST(replace(source, 'src', CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS DOUBLE) AS v FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("source", F.lit("src"), F.lit("x"))).otherwise(F.replace("source", F.lit("src"), F.lit("")))
    return docs.select("doc_id", text.try_cast("double").alias("v"))


@query("o09_epoch", "SELECT event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS t FROM events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    k = F.col("event_id") % 6
    spelled = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
        .when(k == 3, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).when(k == 4, (F.unix_seconds("ts") * 1000).cast("string"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.0000000+00:00'"))
    )
    return e.select("event_id", times.to_epoch(spelled).alias("t"))


_DIRTY = """SELECT track_id, n, CASE WHEN event_id % 83 = 0 THEN NULL ELSE t END AS t,
  CASE WHEN event_id % 97 = 0 THEN 0.0::DOUBLE WHEN event_id % 89 = 0 THEN 95.0::DOUBLE ELSE lat END AS lat,
  CASE WHEN event_id % 97 = 0 THEN 0.0::DOUBLE WHEN event_id % 79 = 0 THEN 'NaN'::DOUBLE ELSE lon END AS lon FROM fx"""


@query("o10_clean", over(f"SELECT track_id, n, t FROM ({_DIRTY}) WHERE t IS NOT NULL AND abs(lat) <= 90 AND NOT isnan(lon) AND abs(lon) <= 180 AND NOT (abs(lat) < 1e-9 AND abs(lon) < 1e-9)", "fx"))
def _(spark, d):
    e = F.col("event_id")
    dirty = Tables(spark, d).fixes.withColumns({
        "t": F.when(e % 83 != 0, F.col("t")),
        "lat": F.when(e % 97 == 0, 0.0).when(e % 89 == 0, 95.0).otherwise(F.col("lat")),
        "lon": F.when(e % 97 == 0, 0.0).when(e % 79 == 0, float("nan")).otherwise(F.col("lon")),
    })
    return motion.drop_unusable(dirty).select("track_id", "n", "t")


@query("o11_first_of_each_time", over("SELECT track_id, t, min(n) AS n FROM (SELECT track_id, floor(t / 10.0::DOUBLE) * 10 AS t, n FROM fx) GROUP BY track_id, t", "fx"))
def _(spark, d):
    coarse = Tables(spark, d).fixes.withColumn("t", (F.floor(F.col("t") / 10.0) * 10).cast("double"))
    return motion.first_of_each_time(coarse, "n").select("track_id", "t", "n")


@query("o14_history_window", over("""SELECT track_id, n, t FROM fx WHERE t >= track_id*86400 + 500 AND t < track_id*86400 + 1500
UNION ALL SELECT track_id, n, t FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t DESC, n DESC) AS q FROM fx WHERE t < track_id*86400 + 500) WHERE q = 1""", "fx"))
def _(spark, d):
    fx = Tables(spark, d).fixes.select("track_id", "t", "n")
    return results.history_window(fx, F.col("track_id") * 86400 + 500, F.col("track_id") * 86400 + 1500, "track_id")


@query("o30_anchor", over("SELECT project_id, round(CAST(sum(CAST(round(lat*1e9) AS HUGEINT)) AS DOUBLE)/count(*)/1e9, 9) AS lat0, round(CAST(sum(CAST(round(lon*1e9) AS HUGEINT)) AS DOUBLE)/count(*)/1e9, 9) AS lon0 FROM fx GROUP BY 1", "fx"))
def _(spark, d):
    return Tables(spark, d).fixes.groupBy("project_id").agg(F.round(geo.mean_exact(F.col("lat")), 9).alias("lat0"), F.round(geo.mean_exact(F.col("lon")), 9).alias("lon0"))


_MLAT = "radians(1.0::DOUBLE) * 6378137.0::DOUBLE * (1 - e2) / pow(1 - e2*sin(radians(lat0))*sin(radians(lat0)), 1.5::DOUBLE)"
_MLON = "radians(1.0::DOUBLE) * 6378137.0::DOUBLE / sqrt(1 - e2*sin(radians(lat0))*sin(radians(lat0))) * cos(radians(lat0))"
_E2 = "(1/298.257223563::DOUBLE) * (2 - 1/298.257223563::DOUBLE) AS e2"


@query("o31_metres_per_degree", f"SELECT lat0, round({_MLAT}, 4) AS m_lat, round({_MLON}, 4) AS m_lon FROM (SELECT CAST(n_nationkey * 3 AS DOUBLE) AS lat0, {_E2} FROM nation)")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") * 3).cast("double").alias("lat0"))
    a, b = geo.metres_per_degree(F.col("lat0"))
    return n.select("lat0", F.round(a, 4).alias("m_lat"), F.round(b, 4).alias("m_lon"))


@query("o32_projection", over("SELECT track_id, n, round((lon - 32.8985::DOUBLE) * 87000.0::DOUBLE, 6) AS x, round((lat - 38.3005::DOUBLE) * 111000.0::DOUBLE, 6) AS y, round(x - (lon - 32.8985::DOUBLE) * 87000.0::DOUBLE, 6) + 0 AS off FROM fx", "fx"))
def _(spark, d):
    anchor = [F.lit(v) for v in (38.3005, 32.8985, 111000.0, 87000.0)]
    x, y = geo.forward(F.col("lat"), F.col("lon"), *anchor)
    return Tables(spark, d).fixes.select("track_id", "n", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), (F.round(F.col("x") - x, 6) + 0).alias("off"))


_HAV = "2*6378137.0::DOUBLE*asin(sqrt(least(greatest(sin((radians(b)-radians(a))/2)*sin((radians(b)-radians(a))/2) + cos(radians(a))*cos(radians(b))*sin((radians(lb)-radians(la))/2)*sin((radians(lb)-radians(la))/2), 0), 1)))"


@query("o33_haversine", over(f"SELECT track_id, n, round({_HAV}, 4) AS dist_m FROM (SELECT track_id, n, lat AS a, lon AS la, lead(lat) OVER w AS b, lead(lon) OVER w AS lb FROM fx WINDOW w AS (PARTITION BY track_id ORDER BY n)) WHERE b IS NOT NULL", "fx"))
def _(spark, d):
    w = Window.partitionBy("track_id").orderBy("n")
    fx = Tables(spark, d).fixes.withColumns({"b": F.lead("lat").over(w), "lb": F.lead("lon").over(w)}).where("b is not null")
    return fx.select("track_id", "n", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("b"), F.col("lb")), 4).alias("dist_m"))


@query("o34_o35_o50_segments", over("SELECT track_id, i, t0, dt_s, dist_m, speed_ms FROM sv", "sv"))
def _(spark, d):
    return Tables(spark, d).segments.select("track_id", "i", "t0", "dt_s", "dist_m", "speed_ms")


@query("o36_units", over("SELECT track_id, i, speed_ms * 3.6::DOUBLE AS speed_kmh, dist_m / 10000.0::DOUBLE AS ha_of_1m FROM sv", "sv"))
def _(spark, d):
    return Tables(spark, d).segments.select("track_id", "i", geo.kmh(F.col("speed_ms")).alias("speed_kmh"), geo.hectares(F.col("dist_m")).alias("ha_of_1m"))


@query("o38_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", times.iso_utc(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("iso"))


@query("o39_day_bounds", "SELECT o_orderkey, epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) - (o_orderkey % 14 - 6) * 3600.0::DOUBLE AS day_start, epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) - (o_orderkey % 14 - 6) * 3600.0::DOUBLE + 86400 AS day_end FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    begin = times.day_start(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 14 - 6).cast("double"))
    return o.select("o_orderkey", begin.alias("day_start"), (begin + 86400).alias("day_end"))


@query("o40_clean_prefix", "SELECT c_custkey, trim(regexp_replace(lower(c_name || ' #' || c_mktsegment || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS prefix FROM customer")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", times.clean_prefix(F.concat("c_name", F.lit(" #"), "c_mktsegment", F.lit("!"))).alias("prefix"))


@query("o45_accuracy", over("SELECT track_id, n FROM ok", "ok"))
def _(spark, d):
    return Tables(spark, d).positions.select("track_id", "n")


_SPIKED = "SELECT track_id, n, t, CASE WHEN event_id % 61 = 0 THEN lat + 0.01::DOUBLE ELSE lat END AS lat, lon FROM fx"
_H = "(2*6378137.0::DOUBLE*asin(sqrt(least(greatest(sin((radians({b})-radians({a}))/2)*sin((radians({b})-radians({a}))/2) + cos(radians({a}))*cos(radians({b}))*sin((radians({y})-radians({x}))/2)*sin((radians({y})-radians({x}))/2), 0), 1))))"


@query("o46_spikes", over(f"""SELECT track_id, n FROM (
  SELECT *, {_H.format(a='la', x='xa', b='lat', y='lon')} AS d1, {_H.format(a='lat', x='lon', b='lb', y='xb')} AS d2, {_H.format(a='la', x='xa', b='lb', y='xb')} AS d3 FROM (
    SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS xa, lag(t) OVER w AS ta, lead(lat) OVER w AS lb, lead(lon) OVER w AS xb, lead(t) OVER w AS tb FROM ({_SPIKED}) WINDOW w AS (PARTITION BY track_id ORDER BY n)))
WHERE NOT coalesce(CASE WHEN t - ta > 0 THEN d1/(t - ta) ELSE 0 END > 40 AND CASE WHEN tb - t > 0 THEN d2/(tb - t) ELSE 0 END > 40 AND d3 < d1 + d2 - 1, false)""", "fx"))
def _(spark, d):
    fx = Tables(spark, d).fixes
    return motion.drop_spikes(fx.withColumn("lat", F.when(F.col("event_id") % 61 == 0, F.col("lat") + 0.01).otherwise(F.col("lat")))).select("track_id", "n")


@query("o47_usable_tracks", over("SELECT track_id, n FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS q FROM ok WHERE n < 1 OR track_id % 4 > 0) WHERE q >= 2", "ok"))
def _(spark, d):
    short = Tables(spark, d).positions.where((F.col("n") < 1) | (F.col("track_id") % 4 > 0))
    return motion.usable_tracks(short).select("track_id", "n")


@query("o48_enabled_sessions", over("SELECT track_id, count(*) AS n FROM fx WHERE track_id % 2 = 0 GROUP BY 1", "fx"))
def _(spark, d):
    fx = Tables(spark, d).fixes
    records = fx.select("track_id").distinct().withColumn("enabled", F.col("track_id") % 2 == 0)
    return fx.join(records.where("enabled"), "track_id", "left_semi").groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))


@query("o49_thinned", over("""SELECT track_id, n FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS q, row_number() OVER (PARTITION BY track_id ORDER BY n) - 1 AS j,
  (SELECT count(DISTINCT track_id) FROM fx b WHERE b.project_id = fx.project_id) AS m FROM fx) WHERE j % greatest(1, q // greatest(1, 600 // greatest(1, m))) = 0""", "fx"))
def _(spark, d):
    return motion.thinned(Tables(spark, d).fixes, 600).select("track_id", "n")


@query("o51_in_base", over("SELECT track_id, n, in_base FROM pos", "pos"))
def _(spark, d):
    return Tables(spark, d).positions.select("track_id", "n", "in_base")


@query("o52_states", over("SELECT track_id, i, state FROM ss", "ss"))
def _(spark, d):
    return Tables(spark, d).segments.select("track_id", "i", "state")


@query("o53_runs", over("SELECT track_id, state, min(i) AS first_i, max(i) AS last_i FROM ru GROUP BY track_id, state, run", "ru"))
def _(spark, d):
    return motion.runs(Tables(spark, d).segments, "state", "i").groupBy("track_id", "state", "run").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i")).drop("run")


@query("o54_visits", over("SELECT track_id, visit_no, start_t, end_t FROM vi", "vi"))
def _(spark, d):
    return Tables(spark, d).visits.select("track_id", "visit_no", "start_t", "end_t")


@query("o55_passes", over("SELECT track_id, pass_no, start_i, end_i, start_t, end_t, round(distance_m, 6) AS distance_m FROM ps", "ps"))
def _(spark, d):
    return Tables(spark, d).passes.select("track_id", "pass_no", "start_i", "end_i", "start_t", "end_t", r6("distance_m"))


@query("o56_reentry_gap", over("SELECT track_id, gap_s FROM rg", "rg"))
def _(spark, d):
    return Tables(spark, d).gaps_s.select("track_id", "gap_s")


@query("o58_polylines", over("SELECT track_id, state, min(i) AS a, CAST(max(i) - min(i) + 2 AS INT) AS n_points FROM ru WHERE state IN (1, 2) GROUP BY track_id, state, run", "ru"))
def _(spark, d):
    t = Tables(spark, d)
    return motion.polylines(t.segments, t.positions).select("track_id", "state", "a", F.size("points").alias("n_points"))


@query("o60_pass_loads", over("SELECT track_id, pass_no, load_no FROM pl", "pl"))
def _(spark, d):
    return Tables(spark, d).pass_loads.select("track_id", "pass_no", "load_no")


@query("o61_o63_loads", over("SELECT track_id, load_no, start_t, end_t, is_complete FROM lo", "lo"))
def _(spark, d):
    return Tables(spark, d).loads.select("track_id", "load_no", "start_t", "end_t", "is_complete")


@query("o62_refills", over("SELECT track_id, visit_no, start_t, end_t FROM rf", "rf"))
def _(spark, d):
    return Tables(spark, d).refills.select("track_id", "visit_no", "start_t", "end_t")


@query("o63_load_intervals", over("SELECT track_id, k, start_t, end_t, is_complete FROM li", "li"))
def _(spark, d):
    return Tables(spark, d).intervals.select("track_id", "k", "start_t", "end_t", "is_complete")


@query("o75_distances", over("""SELECT project_id, round(sum(dist_m) FILTER (state <> 4), 4) AS total_distance_m, round(coalesce(sum(dist_m) FILTER (state = 2), 0), 4) AS transport_distance_m, sum(dt_s) FILTER (state = 1) AS spraying_time_s
FROM ss WHERE track_id IN (SELECT track_id FROM ps) GROUP BY 1""", "ss", "ps"))
def _(spark, d):
    t = Tables(spark, d)
    return metrics.worked_times(t.segments, t.passes).select("project_id", r6("total_distance_m", 4), r6("transport_distance_m", 4), "spraying_time_s")


@query("o76_extents", over("""SELECT project_id, min(t) AS start, max(t) AS "end", count(*) AS points_used, (SELECT count(*) FROM fx WHERE fx.project_id = pos.project_id AND track_id IN (SELECT track_id FROM ps)) AS points_raw,
  count(DISTINCT track_id) || ' sessions' AS track FROM pos WHERE track_id IN (SELECT track_id FROM ps) GROUP BY 1""", "pos", "ps"))
def _(spark, d):
    t = Tables(spark, d)
    return metrics.extents_in_time(t.fixes, t.positions, t.passes).select("project_id", "start", "end", "points_used", "points_raw", "track")


@query("o79_fix_density", over("""SELECT track_id, n, spacing_m, interval_s, spacing_m > 1 AS sparse FROM (
  SELECT track_id, count(*) AS n, quantile_cont(dist_m, 0.5) AS spacing_m, quantile_cont(dt_s, 0.5) AS interval_s FROM ss WHERE state = 1 GROUP BY 1) WHERE n >= 5""", "ss"))
def _(spark, d):
    return metrics.fix_density(Tables(spark, d).segments, Settings()).select("track_id", "n", "spacing_m", "interval_s", "sparse")


@query("o80_accuracy_check", over("SELECT track_id, quantile_cont(accuracy_m, 0.5) AS median_m, quantile_cont(accuracy_m, 0.5) > 2 AS coarse FROM fx GROUP BY 1", "fx"))
def _(spark, d):
    return metrics.coarse_accuracy(Tables(spark, d).fixes, Settings()).select("track_id", "median_m", "coarse")


@query("o82_track_order", over("SELECT project_id, track_id, track_ord FROM tk", "tk"))
def _(spark, d):
    return Tables(spark, d).order


@query("o84_centre", over("SELECT project_id, (min(lat) + max(lat)) / 2 AS lat, (min(lon) + max(lon)) / 2 AS lon FROM fx GROUP BY 1", "fx"))
def _(spark, d):
    return results.centre(Tables(spark, d).fixes)
