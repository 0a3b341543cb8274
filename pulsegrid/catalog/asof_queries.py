"""As-of joins: the newest vector of each endpoint at every minute, and the newest measurement at every request."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.inputs import EVC_SQL, r6, request_events, tidy
from pulsegrid.catalog.registry import query
from pulsegrid.operators.asof import asof_join

RECENT, FRESH = 180, 900  # seconds that a vector, or a measurement, counts


@query("k03b_vector_as_of_minute", f"""WITH {EVC_SQL},
  m AS (SELECT endpoint, ms, max(event_id) AS event_id, arg_max(latency_ms, event_id) AS latency_ms FROM ev GROUP BY endpoint, ms),
  g AS (SELECT endpoint, unnest(range(min(sec) // 60, max(sec) // 60 + 5)) * 60000 AS due FROM ev GROUP BY endpoint)
  SELECT g.endpoint, epoch_ms(due) AS minute, CASE WHEN due - ms <= {RECENT * 1000} THEN event_id::VARCHAR END AS event_id,
    {r6(f'CASE WHEN due - ms <= {RECENT * 1000} THEN latency_ms END')} AS latency_ms
  FROM g ASOF LEFT JOIN m ON g.endpoint = m.endpoint AND g.due >= m.ms""")
def k03b(spark, sf):
    """What a cycle at each minute scores: also minutes without events, until the newest is three minutes old."""
    ev = request_events(spark, sf, compress=True)
    first, last = F.min(F.date_trunc("minute", "ts")), F.max(F.date_trunc("minute", "ts"))
    grid = ev.groupBy("endpoint").agg(first.alias("first"), last.alias("last")).select(
        "endpoint", F.explode(F.expr("sequence(first, last + interval 4 minutes, interval 1 minute)")).alias("minute"))
    found = asof_join(grid, ev.withColumn("id", F.col("event_id")), ["endpoint"], ts="minute", values=["id", "latency_ms"], tie=["event_id"], tolerance=RECENT)
    return tidy(found.select("endpoint", "minute", F.col("id").cast("string").alias("event_id"), "latency_ms"))


@query("t08c_infra_as_of", f"""WITH {EVC_SQL},
  m AS (SELECT client_id, ms, arg_max(latency_ms, event_id) AS measured FROM ev WHERE status = 500 GROUP BY client_id, ms)
  SELECT ev.event_id, {r6(f'CASE WHEN ev.ms - m.ms <= {FRESH * 1000} THEN measured END')} AS measured,
    CASE WHEN ev.ms - m.ms <= {FRESH * 1000} THEN epoch_ms(m.ms) END AS measured_at
  FROM ev ASOF LEFT JOIN m ON ev.client_id = m.client_id AND ev.ms >= m.ms""")
def t08c(spark, sf):
    """Each request with its client's newest failure, as an irregular measurement, of the last quarter of an hour."""
    ev = request_events(spark, sf, compress=True)
    failures = ev.where("status = 500").select("client_id", "ts", "event_id", F.col("latency_ms").alias("measured"))
    found = asof_join(ev.select("event_id", "client_id", "ts"), failures, ["client_id"], values=["measured"], tie=["event_id"],
                      tolerance=FRESH, matched="measured_at")
    return tidy(found.select("event_id", "measured", "measured_at"))
