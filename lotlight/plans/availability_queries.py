"""Occupancy history, availability and allocation over `events`."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotlight.functions.time import day_type, slot_of, window_cells
from lotlight.operators import availability as av
from lotlight.operators import intervals, simulation
from lotlight.plans.bindings import EVENTS, GRID, LOG, SLOT, SPANS, bookings, declarations, events, log, requests
from lotlight.plans.registry import query

SLOTS = 1440 // SLOT
START, END = datetime(2024, 1, 15, 22), datetime(2024, 1, 16, 4)
WEEK = "CASE WHEN isodow({}) >= 6 THEN 'weekend' ELSE 'weekday' END"


def grid(spark, d):
    return av.slot_grid(log(spark, d), SLOT)


@query("prj_log", f"WITH {LOG} SELECT event_id, spot_id, occupied, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST((hour(ts) * 60 + minute(ts)) // {SLOT} AS INTEGER) AS slot FROM obs")
def prj_log(spark, d):
    return log(spark, d).select("event_id", "spot_id", "occupied", F.to_date("ts").cast("string").alias("date"), slot_of(F.col("ts"), SLOT).alias("slot"))


@query("occ_slot_grid", f"WITH {GRID} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM grid")
def occ_slot_grid(spark, d):
    return grid(spark, d).withColumn("date", F.col("date").cast("string"))


def _profile_sql(kind: str) -> str:
    return f"""WITH {GRID}, g AS (SELECT *, {kind} AS day_type FROM grid), p AS (SELECT DISTINCT spot_id, day_type FROM g)
SELECT p.spot_id, p.day_type, CAST(s.slot AS INTEGER) AS slot, round(1 - avg(g.occ), 6) AS p_free, count(g.occ) AS n_days
FROM p CROSS JOIN range({SLOTS}) s(slot) LEFT JOIN g ON g.spot_id = p.spot_id AND g.day_type = p.day_type AND g.slot = s.slot GROUP BY ALL"""


@query("occ_profile", _profile_sql(WEEK.format("date")))
def occ_profile(spark, d):
    return av.profile(grid(spark, d), SLOT).withColumn("p_free", F.round("p_free", 6))


@query("occ_profile_dow", _profile_sql("dayname(date)"))
def occ_profile_dow(spark, d):
    return av.profile(grid(spark, d), SLOT, "dow").withColumn("p_free", F.round("p_free", 6))


_WINDOW = f"""WITH {GRID}, days AS (SELECT DISTINCT spot_id, date FROM grid WHERE isodow(date) < 6), w(o, slot) AS (VALUES (0, 11), (1, 0), (1, 1)),
c AS (SELECT d.spot_id, d.date, w.o, w.slot, g.occ FROM days d CROSS JOIN w LEFT JOIN grid g ON g.spot_id = d.spot_id AND g.date = d.date + CAST(w.o AS INTEGER) AND g.slot = w.slot)"""


@query("jn_window_cells", f"{_WINDOW} SELECT spot_id, CAST(date AS VARCHAR) AS date, o AS day_offset, slot, CAST(occ AS VARCHAR) AS occ FROM c")
def jn_window_cells(spark, d):
    g = grid(spark, d)
    return av.cells_of_days(g, av.shapes(av.one_window(spark, START, END), SLOT)).drop("shape").withColumns({"date": F.col("date").cast("string"), "occ": F.col("occ").cast("string")})


@query("win_free_prob", f"""{_WINDOW}, k AS (SELECT spot_id, date, coalesce(max(occ), 0) AS worst FROM c GROUP BY ALL HAVING count(*) - count(occ) <= 0.25 * count(*)),
n AS (SELECT spot_id, count(*) AS n, count(*) FILTER (worst = 0) AS ok FROM k GROUP BY spot_id)
SELECT s.spot_id, round((ok + 0.5) / (n + 1), 6) AS p_free, coalesce(n, 0) AS n_days, coalesce(ok, 0) AS free_days FROM (SELECT DISTINCT spot_id FROM grid) s LEFT JOIN n ON n.spot_id = s.spot_id""")
def win_free_prob(spark, d):
    out = av.window_free_prob(grid(spark, d), av.one_window(spark, START, END), SLOT)
    return out.select("spot_id", F.round("p_free", 6).alias("p_free"), "n_days", "free_days")


@query("jn_booking_overlap", f"WITH {EVENTS}, {SPANS} SELECT id AS request, spot_id FROM req r WHERE EXISTS (SELECT 1 FROM book b WHERE b.spot_id = r.spot_id AND b.s < r.e AND r.s < b.e)")
def jn_booking_overlap(spark, d):
    return av.booked(requests(spark, d), bookings(spark, d)).select("request", "spot_id")


@query("jn_declared_contains", f"WITH {EVENTS}, {SPANS} SELECT id AS request, spot_id FROM req r WHERE EXISTS (SELECT 1 FROM decl a WHERE a.spot_id = r.spot_id AND a.s <= r.s AND r.e <= a.e)")
def jn_declared_contains(spark, d):
    return av.declared(requests(spark, d), declarations(spark, d)).select("request", "spot_id")


_LIVE = """live AS (SELECT r.id, s.spot_id, coalesce(arg_max(o.occupied, (o.ts, o.occupied)), 0) AS now FROM req r CROSS JOIN (SELECT DISTINCT spot_id FROM obs) s
LEFT JOIN obs o ON o.spot_id = s.spot_id AND o.ts <= r.s GROUP BY ALL)"""


@query("jn_live_status", f"WITH {LOG}, {SPANS}, {_LIVE} SELECT id AS request, spot_id, CAST(now AS INTEGER) AS occupied FROM live")
def jn_live_status(spark, d):
    return intervals.live_status(requests(spark, d), log(spark, d))


def frames(spark, d):
    """Every event is a frame."""
    return events(spark, d).select("ts").distinct()


_FRAMES = "fr AS (SELECT DISTINCT ts FROM ev)"


@query("jn_asof_nearest", f"WITH {EVENTS}, {SPANS}, {_FRAMES} SELECT r.id AS request, arg_min(f.ts, (abs(epoch_us(f.ts) - epoch_us(r.s)), f.ts)) AS frame_ts FROM req r, fr f GROUP BY r.id")
def jn_asof_nearest(spark, d):
    return intervals.asof(requests(spark, d), frames(spark, d))


@query("jn_asof_backward", f"WITH {EVENTS}, {SPANS}, {_FRAMES} SELECT r.id AS request, f.ts AS frame_ts FROM req r ASOF LEFT JOIN fr f ON r.s >= f.ts")
def jn_asof_backward(spark, d):
    return intervals.asof(requests(spark, d), frames(spark, d), direction="backward")


def truth(spark, d):
    return log(spark, d).select("spot_id", "ts", F.when(F.col("event_id") % 10 == 0, -1).otherwise(F.col("occupied")).alias("truth"))


_TRUTH = "tr AS (SELECT spot_id, ts, CASE WHEN event_id % 10 = 0 THEN -1 ELSE occupied END AS truth FROM obs)"
_STAYED = f"{_TRUTH}, st AS (SELECT b.id, b.spot_id, bool_and(t.truth = 0) AS stayed FROM book b LEFT JOIN tr t ON t.spot_id = b.spot_id AND t.truth >= 0 AND b.s <= t.ts AND t.ts < b.e GROUP BY ALL)"


@query("jn_range_stayed_free", f"WITH {LOG}, {SPANS}, {_STAYED} SELECT id AS booking, spot_id, stayed AS stayed_free FROM st")
def jn_range_stayed_free(spark, d):
    return intervals.stayed_free(bookings(spark, d), truth(spark, d)).select("booking", "spot_id", "stayed_free")


@query("agg_rate", f"WITH {LOG}, {SPANS}, {_STAYED} SELECT spot_id, round(avg(CAST(stayed AS INTEGER)), 6) AS rate, count(stayed) AS n FROM st GROUP BY spot_id")
def agg_rate(spark, d):
    s = intervals.stayed_free(bookings(spark, d), truth(spark, d))
    return s.groupBy("spot_id").agg(F.round(F.avg(F.col("stayed_free").cast("int")), 6).alias("rate"), F.count("stayed_free").alias("n"))


@query("flt_dropna", f"WITH {LOG}, {SPANS}, {_STAYED} SELECT id AS booking, stayed AS stayed_free FROM st WHERE stayed IS NOT NULL")
def flt_dropna(spark, d):
    return intervals.stayed_free(bookings(spark, d), truth(spark, d)).dropna(subset=["stayed_free"]).select("booking", "stayed_free")


@query("jn_truth_lookup", f"WITH {LOG}, {_FRAMES}, ff AS (SELECT f.ts, s.spot_id FROM fr f CROSS JOIN (SELECT DISTINCT spot_id FROM obs) s) SELECT ff.ts, ff.spot_id, coalesce(o.occupied, -1) AS truth FROM ff LEFT JOIN obs o ON o.ts = ff.ts AND o.spot_id = ff.spot_id")
def jn_truth_lookup(spark, d):
    every = frames(spark, d).crossJoin(log(spark, d).select("spot_id").distinct())
    return every.join(log(spark, d).select("ts", "spot_id", "occupied"), ["ts", "spot_id"], "left").select("ts", "spot_id", F.coalesce("occupied", F.lit(-1)).alias("truth"))


_CAND = f"""{GRID}, {SPANS}, {_LIVE}, rw AS (SELECT id, s, e, CAST(date_trunc('day', s) AS DATE) AS d0, isodow(s) >= 6 AS we, e + INTERVAL 30 MINUTE AS b FROM req),
cells AS (SELECT id, d0, we, unnest(generate_series(time_bucket(INTERVAL {SLOT} MINUTE, s, TIMESTAMP '2000-01-01'), b - INTERVAL 1 MICROSECOND, INTERVAL {SLOT} MINUTE)) AS t FROM rw),
days AS (SELECT DISTINCT spot_id, date FROM grid), cc AS (SELECT c.id, d.spot_id, d.date, g.occ FROM cells c JOIN days d ON (isodow(d.date) >= 6) = c.we
  LEFT JOIN grid g ON g.spot_id = d.spot_id AND g.date = d.date + CAST(CAST(c.t AS DATE) - c.d0 AS INTEGER) AND g.slot = (hour(c.t) * 60 + minute(c.t)) // {SLOT}),
k AS (SELECT id, spot_id, date, coalesce(max(occ), 0) AS worst FROM cc GROUP BY ALL HAVING count(*) - count(occ) <= 0.25 * count(*)),
np AS (SELECT id, spot_id, count(*) AS n, count(*) FILTER (worst = 0) AS ok FROM k GROUP BY ALL),
pairs AS (SELECT r.id, r.s, r.e, s.spot_id, coalesce(n, 0) AS n_days, (ok + 0.5) / (n + 1) AS p_free FROM req r CROSS JOIN (SELECT DISTINCT spot_id FROM grid) s LEFT JOIN np ON np.id = r.id AND np.spot_id = s.spot_id),
fl AS (SELECT p.*, EXISTS (SELECT 1 FROM decl a WHERE a.spot_id = p.spot_id AND a.s <= p.s AND p.e <= a.e) AS declared_away,
  EXISTS (SELECT 1 FROM book b WHERE b.spot_id = p.spot_id AND b.s < p.e AND p.s < b.e) AS booked, l.now <> 0 AS occupied_now FROM pairs p JOIN live l ON l.id = p.id AND l.spot_id = p.spot_id),
cf AS (SELECT *, CASE WHEN declared_away THEN 1.0 WHEN n_days < 3 THEN 0.0 ELSE p_free END AS confidence FROM fl),
el AS (SELECT *, NOT booked AND NOT occupied_now AND confidence >= 0.5 AS eligible FROM cf),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY eligible DESC, confidence DESC NULLS LAST, n_days DESC, spot_id) AS rank FROM el)"""


def ranked(spark, d):
    asked = requests(spark, d).select("request", "start", "end")
    live = intervals.live_status(asked, log(spark, d))
    return av.candidates(grid(spark, d), asked, SLOT, bookings(spark, d), declarations(spark, d), live, min_confidence=0.5)


@query("alloc_candidates", f"WITH {_CAND} SELECT id AS request, spot_id, n_days, round(p_free, 6) AS p_free, declared_away, booked, occupied_now, round(confidence, 6) AS confidence, eligible FROM rk")
def alloc_candidates(spark, d):
    return ranked(spark, d).select("request", "spot_id", "n_days", F.round("p_free", 6).alias("p_free"), "declared_away", "booked", "occupied_now", F.round("confidence", 6).alias("confidence"), "eligible")


@query("srt_candidates", f"WITH {_CAND} SELECT id AS request, spot_id, CAST(rank AS INTEGER) AS rank FROM rk")
def srt_candidates(spark, d):
    return ranked(spark, d).select("request", "spot_id", "rank")


@query("top1_request", f"WITH {_CAND} SELECT id AS request, spot_id, round(confidence, 6) AS confidence FROM rk WHERE rank = 1 AND eligible")
def top1_request(spark, d):
    return av.top_candidate(ranked(spark, d)).select("request", "spot_id", F.round("confidence", 6).alias("confidence"))


@query("agg_sweep", f"""WITH {_CAND}, t(thr) AS (VALUES (0.5), (0.7), (0.9)), ok AS (SELECT t.thr, k.id, max(confidence) AS best FROM t CROSS JOIN rk k WHERE NOT booked AND NOT occupied_now AND confidence >= t.thr GROUP BY ALL)
SELECT CAST(t.thr AS DOUBLE) AS threshold, count(ok.id) AS n_booked, round(avg(best), 6) AS mean_confidence FROM t LEFT JOIN ok ON ok.thr = t.thr GROUP BY t.thr""")
def agg_sweep(spark, d):
    free = ranked(spark, d).where("NOT booked AND NOT occupied_now").groupBy("request").agg(F.max("confidence").alias("best"))
    swept = free.withColumn("threshold", F.explode(F.array(F.lit(0.5), F.lit(0.7), F.lit(0.9))))
    hit = F.col("best") >= F.col("threshold")
    return swept.groupBy("threshold").agg(F.count_if(hit).alias("n_booked"), F.round(F.avg(F.when(hit, F.col("best"))), 6).alias("mean_confidence"))


@query("alloc_request", f"""WITH RECURSIVE {_CAND},
el2 AS (SELECT id, spot_id, s, e, confidence, rank, CAST(s AS DATE) AS day FROM rk WHERE eligible), o AS (SELECT id, any_value(day) AS day, row_number() OVER (PARTITION BY any_value(day) ORDER BY any_value(s), id) AS k FROM el2 GROUP BY id),
go AS (SELECT DISTINCT day, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(spot VARCHAR, s TIMESTAMP, e TIMESTAMP)[]) AS taken, CAST(NULL AS STRUCT(id BIGINT, spot VARCHAR, s TIMESTAMP, e TIMESTAMP, c DOUBLE)) AS made FROM o UNION ALL
SELECT g.day, g.k + 1, CASE WHEN x.made IS NULL THEN g.taken ELSE list_append(g.taken, {{'spot': x.made.spot, 's': x.made.s, 'e': x.made.e}}) END, x.made
FROM go g JOIN LATERAL (SELECT (SELECT arg_min({{'id': c.id, 'spot': c.spot_id, 's': c.s, 'e': c.e, 'c': CAST(c.confidence AS DOUBLE)}}, c.rank) FROM el2 c WHERE c.id = o.id AND len(list_filter(g.taken, lambda t: t.spot = c.spot_id AND t.s < c.e AND c.s < t.e)) = 0) AS made FROM o WHERE o.day = g.day AND o.k = g.k + 1) x ON true)
SELECT made.id AS request, made.spot AS spot_id, made.s AS begins, made.e AS ends, round(made.c, 6) AS confidence FROM go WHERE made IS NOT NULL""")
def alloc_request(spark, d):
    """Requests booked one after another within each day, against earlier bookings too."""
    return av.allocate(ranked(spark, d).withColumn("day", F.to_date("start"))).select("request", "spot_id", F.col("start").alias("begins"), F.col("end").alias("ends"), F.round("confidence", 6).alias("confidence"))


@query("sim_guest")
def sim_guest(spark, d):
    """Replay at three confidences and by what is free now: how many requests were booked, and how many of the bookings' spots stayed free."""
    asked = requests(spark, d).select("request", "start", "end")
    live = intervals.live_status(asked, log(spark, d)).persist()
    both = av.candidates(grid(spark, d), asked, SLOT, bookings(spark, d), declarations(spark, d), live, min_confidence=0.5).withColumn("day", F.to_date("start"))
    _, total = simulation.sweep(both, live, truth(spark, d), [0.5, 0.7, 0.9])
    return total.withColumn("rate", F.round("rate", 6))


@query("flt_train_test_days", f"WITH {LOG}, dd AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM obs) SELECT CAST(date AS VARCHAR) AS date, CASE WHEN row_number() OVER (ORDER BY date DESC) <= 7 THEN 'test' ELSE 'train' END AS part FROM dd")
def flt_train_test_days(spark, d):
    days = log(spark, d).select(F.to_date("ts").alias("date")).distinct()
    last = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date")))
    return days.select(F.col("date").cast("string").alias("date"), F.when(last <= 7, "test").otherwise("train").alias("part"))


@query("flt_between", _profile_sql(WEEK.format("date")).replace("WITH", "SELECT * FROM (WITH", 1) + ") WHERE slot BETWEEN 4 AND 8 AND day_type = 'weekday'")
def flt_between(spark, d):
    return occ_profile(spark, d).where(F.col("slot").between(4, 8) & (F.col("day_type") == "weekday"))


@query("agg_pivot", f"SELECT spot_id, {', '.join(f'round(max(p_free) FILTER (slot = {k}), 6) AS slot_{k}' for k in range(SLOTS))} FROM ({_profile_sql(WEEK.format('date'))}) WHERE day_type = 'weekday' GROUP BY spot_id")
def agg_pivot(spark, d):
    wide = occ_profile(spark, d).where("day_type = 'weekday'").groupBy("spot_id").pivot("slot", list(range(SLOTS))).agg(F.max("p_free"))
    return wide.select("spot_id", *[F.col(f"`{k}`").alias(f"slot_{k}") for k in range(SLOTS)])


@query("flt_window_end", f"WITH {EVENTS}, {SPANS} SELECT id AS request FROM req WHERE e <= date_trunc('day', s) + INTERVAL 18 HOUR")
def flt_window_end(spark, d):
    return requests(spark, d).where(F.col("end") <= F.date_trunc("day", "start").cast("timestamp_ntz") + F.expr("INTERVAL 18 HOUR")).select("request")


@query("fn_slot_sequence", f"WITH {EVENTS}, {SPANS} SELECT id AS request, CAST(date_diff('day', s, t) AS INTEGER) AS day_offset, CAST((hour(t) * 60 + minute(t)) // 30 AS INTEGER) AS slot FROM (SELECT id, s, unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, s, TIMESTAMP '2000-01-01'), e - INTERVAL 1 MICROSECOND, INTERVAL 30 MINUTE)) AS t FROM req)")
def fn_slot_sequence(spark, d):
    return requests(spark, d).select("request", F.explode(window_cells(F.col("start"), F.col("end"), 30)).alias("c")).select("request", "c.day_offset", "c.slot")


@query("fn_day_type", f"WITH {EVENTS} SELECT event_id, {WEEK.format('ts')} AS day_type, dayname(ts) AS dow FROM ev")
def fn_day_type(spark, d):
    return events(spark, d).select("event_id", day_type(F.to_date("ts")).alias("day_type"), day_type(F.to_date("ts"), "dow").alias("dow"))
