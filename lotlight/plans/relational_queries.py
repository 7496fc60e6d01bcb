"""Filters, projections, joins, set operations and sequence operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotlight.operators import discovery
from lotlight.operators import sequences as sq
from lotlight.plans.bindings import EVENTS, LOG, events, log, table
from lotlight.operators.learning import draw
from lotlight.plans.registry import query


@query("prj_rename", f"WITH {LOG} SELECT event_id, occupied AS pred FROM obs WHERE CAST(ts AS DATE) < DATE '2024-01-20'")
def prj_rename(spark, d):
    return log(spark, d).where(F.to_date("ts") < F.lit("2024-01-20").cast("date")).withColumnRenamed("occupied", "pred").select("event_id", "pred")


@query("flt_isin", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'click') AND user_id % 10 IN (1, 2, 3)")
def flt_isin(spark, d):
    return events(spark, d).where(~F.col("event_type").isin("error", "click") & (F.col("user_id") % 10).isin(1, 2, 3)).select("event_id", "event_type")


@query("flt_labelled", f"WITH {LOG}, t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE occupied END AS truth FROM obs) SELECT * FROM t WHERE truth >= 0")
def flt_labelled(spark, d):
    return log(spark, d).select("event_id", F.when(F.col("event_id") % 10 == 0, -1).otherwise(F.col("occupied")).alias("truth")).where("truth >= 0")


@query("flt_threshold", "SELECT event_id, CAST(value >= 50 AS INTEGER) AS pred FROM events")
def flt_threshold(spark, d):
    return events(spark, d).select("event_id", (F.col("value") >= 50).cast("int").alias("pred"))


@query("flt_demo_score", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice / 100000 >= 0.75")
def flt_demo_score(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_extendedprice") / 100000 >= 0.75).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("flt_regex_name", "SELECT p_partkey, p_name, starts_with(p_name, 'a') AS is_a FROM part WHERE NOT regexp_matches(p_name, '1|7')")
def flt_regex_name(spark, d):
    return table(spark, d, "part").where(~F.col("p_name").rlike("1|7")).select("p_partkey", "p_name", F.col("p_name").startswith("a").alias("is_a"))


@query("flt_sample_every", "SELECT event_id FROM events WHERE event_id % 25 = 0")
def flt_sample_every(spark, d):
    return events(spark, d).where(F.pmod("event_id", F.lit(25)) == 0).select("event_id")


@query("flt_car_count", "SELECT l_orderkey AS frame, count(*) AS n_cars FROM lineitem GROUP BY ALL HAVING count(*) BETWEEN 2 AND 6")
def flt_car_count(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.count("*").alias("n_cars")).where("n_cars BETWEEN 2 AND 6")


@query("prj_label_name", f"WITH {LOG} SELECT event_id, CASE occupied WHEN 0 THEN 'empty' WHEN 1 THEN 'occupied' ELSE 'unlabeled' END AS label FROM obs")
def prj_label_name(spark, d):
    o = F.col("occupied")
    return log(spark, d).select("event_id", F.when(o == 0, "empty").when(o == 1, "occupied").otherwise("unlabeled").alias("label"))


@query("prj_columns", "SELECT vec_id, CAST(list_sum(list_transform(embedding[9:24], lambda x: CAST(round(x * 1000) AS BIGINT))) AS BIGINT) AS block_sum, CAST(len(embedding[9:24]) AS INTEGER) AS n FROM embeddings")
def prj_columns(spark, d):
    block = F.slice("embedding", 9, 16)
    total = F.aggregate(block, F.lit(0).cast("long"), lambda a, x: a + F.round(x * F.lit(1000).cast("float")).cast("long"))  # a product of single precision, as in SQL
    return table(spark, d, "embeddings").select("vec_id", total.alias("block_sum"), F.size(block).alias("n"))


@query("smp_without_replacement", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|0'), o_orderkey LIMIT 100")
def smp_without_replacement(spark, d):
    """A seeded sample of 100 orders in their own order: those whose keys hash lowest."""
    drawn = table(spark, d, "orders").select("o_orderkey").orderBy(draw("o_orderkey"), "o_orderkey").limit(100)
    return drawn.orderBy("o_orderkey")


@query("jn_bays_labels", """SELECT e.event_id, e.user_id % 25 AS slot_id, n.n_name AS bay, CAST(n.n_regionkey * 1000.0 / 2592 AS DOUBLE) AS x FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25 WHERE n.n_regionkey NOT IN (0, 1)""")
def jn_bays_labels(spark, d):
    bays = table(spark, d, "nation").where(~F.col("n_regionkey").isin(0, 1)).select(F.col("n_nationkey").cast("long").alias("slot_id"), F.col("n_name").alias("bay"), (F.col("n_regionkey") * 1000.0 / 2592).alias("x"))
    return events(spark, d).select("event_id", (F.col("user_id") % 25).alias("slot_id")).join(bays, "slot_id")


@query("jn_file_exists", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn_file_exists(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query("jn_cooccurrence", """WITH f AS (SELECT DISTINCT l_returnflag || l_linestatus || (l_linenumber % 4) AS site, l_orderkey AS frame FROM lineitem), n AS (SELECT site, count(*) AS n FROM f GROUP BY site),
c AS (SELECT a.site AS a, b.site AS b, count(*) AS n_both FROM f a JOIN f b ON a.frame = b.frame AND a.site < b.site GROUP BY ALL)
SELECT c.a AS site_a, c.b AS site_b, n_both, round(CAST(n_both AS DOUBLE) / greatest(least(na.n, nb.n), 1), 6) AS cooc FROM c JOIN n na ON na.site = c.a JOIN n nb ON nb.site = c.b""")
def jn_cooccurrence(spark, d):
    site = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber") % 4)
    f = table(spark, d, "lineitem").select(site.alias("site"), F.col("l_orderkey").alias("frame")).distinct()
    n = f.groupBy("site").agg(F.count("*").alias("n"))
    both = f.withColumnRenamed("site", "site_a").join(f.withColumnRenamed("site", "site_b"), "frame").where("site_a < site_b").groupBy("site_a", "site_b").agg(F.count("*").alias("n_both"))
    sized = both.join(n.select(F.col("site").alias("site_a"), F.col("n").alias("na")), "site_a").join(n.select(F.col("site").alias("site_b"), F.col("n").alias("nb")), "site_b")
    return sized.select("site_a", "site_b", "n_both", F.round(F.col("n_both") / F.greatest(F.least("na", "nb"), F.lit(1)), 6).alias("cooc"))


@query("agg_count_distinct", f"WITH {LOG} SELECT spot_id, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT ts) AS frames FROM obs GROUP BY spot_id")
def agg_count_distinct(spark, d):
    return log(spark, d).groupBy("spot_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count_distinct("ts").alias("frames"))


@query("agg_argmax", f"WITH {LOG} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM obs GROUP BY 1 ORDER BY n DESC, date LIMIT 1")
def agg_argmax(spark, d):
    return log(spark, d).groupBy(F.to_date("ts").cast("string").alias("date")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "date").limit(1)


@query("agg_first", "SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority FROM orders GROUP BY o_custkey")
def agg_first(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_priority"))


@query("agg_quantile", "SELECT label, round(quantile_cont(CAST(embedding[1] AS DOUBLE), 0.01), 6) AS threshold FROM embeddings GROUP BY label")
def agg_quantile(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.percentile(F.get("embedding", F.lit(0)).cast("double"), 0.01), 6).alias("threshold"))


@query("agg_hist", """WITH b AS (SELECT event_type, least(CAST(floor(value / 25) AS INTEGER), 15) AS bin FROM events), n AS (SELECT event_type, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT event_type, bin, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM n""")
def agg_hist(spark, d):
    n = events(spark, d).groupBy("event_type", F.least(F.floor(F.col("value") / 25).cast("int"), F.lit(15)).alias("bin")).agg(F.count("*").alias("n"))
    return n.select("event_type", "bin", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6).alias("share"))


@query("agg_class_balance", f"WITH {LOG} SELECT spot_id, round(avg(occupied), 6) AS rate, count(*) FILTER (occupied = 1) AS n_occupied, count(*) FILTER (occupied = 0) AS n_empty FROM obs GROUP BY spot_id")
def agg_class_balance(spark, d):
    return log(spark, d).groupBy("spot_id").agg(F.round(F.avg("occupied"), 6).alias("rate"), F.count_if(F.col("occupied") == 1).alias("n_occupied"), F.count_if(F.col("occupied") == 0).alias("n_empty"))


@query("set_union_rows", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, NULL AS params FROM nation UNION ALL SELECT r_name, NULL, 'top' FROM region")
def set_union_rows(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    return nations.unionByName(table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("top").alias("params")), allowMissingColumns=True)


@query("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '5%'")
def set_intersect(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    return o.where("o_orderpriority LIKE '1%'").select("k").intersect(o.where("o_orderpriority LIKE '5%'").select("k"))


@query("set_difference", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("set_distinct", "SELECT DISTINCT event_type, user_id % 5 AS camera FROM events")
def set_distinct(spark, d):
    return events(spark, d).select("event_type", (F.col("user_id") % 5).alias("camera")).distinct()


@query("srt_time", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def srt_time(spark, d):
    return events(spark, d).select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("place"))


@query("srt_numeric_id", "SELECT CAST(c_custkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer")
def srt_numeric_id(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_nationkey")
    return c.select("id", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("id").cast("long"))).cast("long").alias("place"))




@query("win_majority", f"WITH {LOG} SELECT event_id, CAST(2 * sum(occupied) OVER w > count(occupied) OVER w AS INTEGER) AS smoothed, occupied FROM obs WINDOW w AS (PARTITION BY spot_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def win_majority(spark, d):
    return sq.majority(log(spark, d), 5, order=("ts", "event_id")).select("event_id", "smoothed", "occupied")


def _flags(spark, d):
    """Presence of each spot by event: the value is over 45."""
    return events(spark, d).select("spot_id", "ts", (F.col("value") > 45).cast("int").alias("present"))


_RUNS = """f AS (SELECT spot_id, ts, CAST(value > 45 AS INTEGER) AS p, row_number() OVER (PARTITION BY spot_id ORDER BY ts) - 1 AS i FROM ev),
gap AS (SELECT spot_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY spot_id ORDER BY ts)) / 60e6 AS g FROM f), step AS (SELECT spot_id, coalesce(median(g), 1.0) AS step FROM gap GROUP BY spot_id),
c1 AS (SELECT *, coalesce(CAST(p <> lag(p) OVER (PARTITION BY spot_id ORDER BY i) AS INTEGER), 0) AS ch FROM f), r1 AS (SELECT *, sum(ch) OVER (PARTITION BY spot_id ORDER BY i) AS run FROM c1),
k1 AS (SELECT r1.spot_id, run, max(p) AS p, min(i) AS a, max(i) AS b, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 + max(step) AS m FROM r1 JOIN step ON step.spot_id = r1.spot_id GROUP BY r1.spot_id, run),
b1 AS (SELECT *, p = 0 AND run > 0 AND run < max(run) OVER (PARTITION BY spot_id) AND m < 60 AS bridge FROM k1),
f2 AS (SELECT r1.spot_id, r1.ts, r1.i, r1.p AS raw, CASE WHEN bridge THEN 1 ELSE r1.p END AS p FROM r1 JOIN b1 ON b1.spot_id = r1.spot_id AND b1.run = r1.run),
c2 AS (SELECT *, coalesce(CAST(p <> lag(p) OVER (PARTITION BY spot_id ORDER BY i) AS INTEGER), 0) AS ch FROM f2), r2 AS (SELECT *, sum(ch) OVER (PARTITION BY spot_id ORDER BY i) AS run FROM c2),
k2 AS (SELECT r2.spot_id, run, max(p) AS p, min(i) AS a, max(i) AS b, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 + max(step) AS m, avg(raw) AS density FROM r2 JOIN step ON step.spot_id = r2.spot_id GROUP BY r2.spot_id, run),
s AS (SELECT *, p = 1 AND m >= 90 AND density >= 0.5 AS stay, coalesce(lead(m) OVER w >= 60, FALSE) AS after, coalesce(lag(m) OVER w >= 60, FALSE) AS before FROM k2 WINDOW w AS (PARTITION BY spot_id ORDER BY run))"""


def presence(spark, d):
    return sq.presence(_flags(spark, d))


@query("win_runs", f"WITH {EVENTS}, {_RUNS} SELECT spot_id, CAST(p AS INTEGER) AS present, CAST(a AS INTEGER) AS first, CAST(b AS INTEGER) AS last, n, round(m, 3) AS minutes FROM k1")
def win_runs(spark, d):
    return sq.runs(presence(spark, d)).select("spot_id", "present", "first", "last", "n", F.round("minutes", 3).alias("minutes"))


@query("win_step", f"WITH {EVENTS}, {_RUNS} SELECT spot_id, round(step, 6) AS step FROM step")
def win_step(spark, d):
    return sq.step_minutes(_flags(spark, d)).select("spot_id", F.round("step", 6).alias("step"))


@query("win_bridge", f"WITH {EVENTS}, {_RUNS} SELECT spot_id, CAST(i AS INTEGER) AS i, CAST(raw AS INTEGER) AS raw, CAST(p AS INTEGER) AS present FROM f2")
def win_bridge(spark, d):
    return sq.bridged(presence(spark, d), 60).select("spot_id", "i", "raw", "present")


def stays(spark, d):
    return sq.stays(sq.bridged(presence(spark, d), 60), 90, 0.5, 60)


@query("win_stays", f"WITH {EVENTS}, {_RUNS} SELECT spot_id, CAST(a AS INTEGER) AS first, CAST(b AS INTEGER) AS last, round(density, 6) AS density FROM s WHERE stay")
def win_stays(spark, d):
    return stays(spark, d).where("stay").select("spot_id", "first", "last", F.round("density", 6).alias("density"))


@query("win_transitions", f"""WITH {EVENTS}, {_RUNS} SELECT spot_id, CAST(b AS INTEGER) AS frame, 'departure' AS kind FROM s WHERE stay AND after UNION ALL SELECT spot_id, CAST(a AS INTEGER), 'arrival' FROM s WHERE stay AND before""")
def win_transitions(spark, d):
    s = stays(spark, d)
    return s.where("departure").select("spot_id", F.col("last").alias("frame"), F.lit("departure").alias("kind")).union(s.where("arrival").select("spot_id", "first", F.lit("arrival")))


@query("win_occupancy_rate", f"WITH {EVENTS}, {_RUNS} SELECT spot_id, round_even(avg(p), 3) AS occupancy_rate FROM f2 GROUP BY spot_id")
def win_occupancy_rate(spark, d):
    return sq.bridged(presence(spark, d), 60).groupBy("spot_id").agg(F.bround(F.avg("present"), 3).alias("occupancy_rate"))


_SUM = """tr AS (SELECT spot_id, true AS leaves, (b * 37 % 100) / 100.0 AS c FROM s WHERE stay AND after UNION ALL SELECT spot_id, false, (a * 37 % 100) / 100.0 FROM s WHERE stay AND before),
tc AS (SELECT spot_id, count(*) FILTER (leaves) AS n_departures, count(*) FILTER (NOT leaves) AS n_arrivals, count(*) FILTER (leaves AND c >= 0.6) AS verified_departures, count(*) FILTER (NOT leaves AND c >= 0.6) AS verified_arrivals, max(c) AS top FROM tr GROUP BY spot_id),
fs AS (SELECT spot_id, CAST(sum(raw) AS BIGINT) AS detections, round_even(avg(p), 3) AS occupancy_rate FROM f2 GROUP BY spot_id), st AS (SELECT spot_id, count(*) FILTER (stay) AS n_stays FROM s GROUP BY spot_id),
sm AS (SELECT st.spot_id, detections, n_stays, coalesce(n_departures, 0) AS n_departures, coalesce(n_arrivals, 0) AS n_arrivals, coalesce(verified_departures, 0) AS verified_departures, coalesce(verified_arrivals, 0) AS verified_arrivals,
  CAST(coalesce(round_even(top, 3), 0) AS DOUBLE) AS max_change, occupancy_rate, CASE WHEN n_stays = 0 THEN 'dropped' WHEN coalesce(verified_departures + verified_arrivals, 0) > 0 THEN 'confirmed' ELSE 'candidate' END AS status
FROM st JOIN fs ON fs.spot_id = st.spot_id LEFT JOIN tc ON tc.spot_id = st.spot_id)"""


def _summary(spark, d):
    """The appearance's change at a transition is a number drawn from its frame's."""
    p = sq.bridged(presence(spark, d), 60)
    runs = sq.stays(p, 90, 0.5, 60)
    drawn = lambda frame: (F.col(frame) * 37 % 100) / 100
    side = lambda flag, kind, frame: runs.where(flag).select("spot_id", "run", F.lit(kind).alias("kind"), drawn(frame).alias("change"))
    change = side("departure", "departure", "last").unionByName(side("arrival", "arrival", "first"))
    return discovery.summarised(p, runs, change, p.groupBy("spot_id").agg(F.sum("raw").cast("long").alias("detections")))


@query("agg_site_summary", f"WITH {EVENTS}, {_RUNS}, {_SUM} SELECT spot_id, detections, n_stays, n_departures, n_arrivals, max_change, status FROM sm")
def agg_site_summary(spark, d):
    return _summary(spark, d).select("spot_id", "detections", "n_stays", "n_departures", "n_arrivals", "max_change", "status")


@query("agg_spot_meta", f"""WITH {EVENTS}, {_RUNS}, {_SUM} SELECT spot_id, status, n_stays, verified_departures AS n_departures, verified_arrivals AS n_arrivals, occupancy_rate FROM sm WHERE status <> 'dropped'""")
def agg_spot_meta(spark, d):
    kept = _summary(spark, d).where("status <> 'dropped'")
    return kept.select("spot_id", "status", "n_stays", F.col("verified_departures").alias("n_departures"), F.col("verified_arrivals").alias("n_arrivals"), "occupancy_rate")


@query("fn_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def fn_json(spark, d):
    return events(spark, d).select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("fn_path_parts", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS first_part FROM pages")
def fn_path_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^/?#]*)", 1).alias("first_part"))


@query("fn_math", "SELECT event_id, round(ln(value), 6) AS log_value, round(1 / (1 + exp(-value / 50)), 6) AS sigmoid, greatest(10.0, least(90.0, value)) AS clipped, round_even(value, 1) AS rounded FROM events")
def fn_math(spark, d):
    """Numbers are rounded by floats, as a multiple of the last digit, like the SQL: decimals decide otherwise where the multiple is a half only by a float's rounding."""
    v = F.col("value")
    digits = lambda c, k, whole: F.when(F.abs(c * 10.0**k) < float("inf"), whole(c * 10.0**k) / 10.0**k).otherwise(c)
    log = F.when(v == 0, float("-inf")).when(v < 0, float("nan")).otherwise(F.log(v))
    return events(spark, d).select("event_id", digits(log, 6, F.round).alias("log_value"), digits(1 / (1 + F.exp(-v / 50)), 6, F.round).alias("sigmoid"), F.greatest(F.lit(10.0), F.least(F.lit(90.0), v)).alias("clipped"), digits(v, 1, F.rint).alias("rounded"))
