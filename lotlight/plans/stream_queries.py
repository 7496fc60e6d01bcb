"""The streaming operators over `events` as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlight.plans.bindings import LOG, SLOT, shared_folder
from lotlight.plans.registry import query
from lotlight.streaming import occupancy as st


def _log(spark, d):
    s = st.event_stream(spark, d)
    return s.select("event_id", "ts", F.concat(F.lit("U"), F.col("user_id") % 8).alias("spot_id"), (F.col("value") > 120).cast("int").alias("occupied"), "event_type")


def _where(spark) -> str:
    return shared_folder(spark, "stream")


@query("st_slot_agg", f"WITH {LOG}, s AS (SELECT spot_id, time_bucket(INTERVAL {SLOT} MINUTE, ts, TIMESTAMP '2000-01-01') AS start, max(occupied) AS occ FROM obs GROUP BY ALL) SELECT * FROM s WHERE start + INTERVAL {SLOT} MINUTE <= (SELECT max(ts) FROM obs) - INTERVAL 1 HOUR")
def st_slot_agg(spark, d):
    return st.run_once(st.slot_stream(_log(spark, d), SLOT), _where(spark))


@query("st_smoother", f"WITH {LOG} SELECT event_id, spot_id, CAST(2 * sum(occupied) OVER w > count(occupied) OVER w AS INTEGER) AS smoothed FROM obs WINDOW w AS (PARTITION BY spot_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def st_smoother(spark, d):
    return st.run_once(st.smooth_stream(_log(spark, d).select("event_id", "ts", "spot_id", "occupied"), 5), _where(spark))


@query("st_bookings", f"""WITH RECURSIVE {LOG}, q AS (SELECT event_id AS request, spot_id, ts AS s, ts + to_hours(CAST(1 + event_id % 4 AS INTEGER)) AS e, row_number() OVER (PARTITION BY spot_id ORDER BY ts, event_id) AS k FROM ev WHERE event_type = 'purchase'),
go AS (SELECT DISTINCT spot_id, CAST(0 AS BIGINT) AS k, TIMESTAMP '1900-01-01' AS until, CAST(NULL AS BIGINT) AS request, false AS ok FROM q UNION ALL
SELECT g.spot_id, q.k, CASE WHEN q.s >= g.until THEN q.e ELSE g.until END, q.request, q.s >= g.until FROM go g JOIN q ON q.spot_id = g.spot_id AND q.k = g.k + 1) SELECT request, spot_id, ok AS booked FROM go WHERE k > 0""")
def st_bookings(spark, d):
    asked = _log(spark, d).where("event_type = 'purchase'")
    end = F.col("ts") + F.make_dt_interval(hours=(1 + F.col("event_id") % 4).cast("int"))
    return st.run_once(st.booking_stream(asked.select(F.col("event_id").alias("request"), "spot_id", F.col("ts").alias("start"), end.alias("end"))), _where(spark))
