"""Clustering, fills, regions, ranks and sessions over ordered rows: windows with a total order."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import Catalogue

_c = Catalogue()
_b = _c.both

_b("gap_cluster", "SELECT user_id, cluster, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(CASE WHEN ts > prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cluster FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events})) GROUP BY user_id, cluster",
   "SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(CASE WHEN ts > prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cluster FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, cluster")
_b("field_forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS field FROM {events}",
   "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS field FROM events")
_b("pending_backfill", "SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM {events}",
   "SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM events")
_b("quantity_attach", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS attached FROM {events}",
   "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS attached FROM events")
_b("region_between_markers", "SELECT conv_id, turn AS begin, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 1000000) AS stop FROM {conversations} WHERE role = 'user'")
_b("group_by_header", "SELECT conv_id, entry, count(*) AS n_rows, sum(length(text)) AS chars FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entry FROM {conversations}) GROUP BY conv_id, entry",
   "SELECT conv_id, CAST(entry AS BIGINT) AS entry, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entry FROM conversations) GROUP BY conv_id, entry")
_b("state_machine_records", "SELECT conv_id, entry, max(CASE WHEN role = 'user' THEN turn END) AS header_turn, count_if(role = 'assistant') AS n_answers, md5(listagg(text, ' ') WITHIN GROUP (ORDER BY turn)) AS body FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entry FROM {conversations}) WHERE entry > 0 GROUP BY conv_id, entry",
   "SELECT conv_id, CAST(entry AS BIGINT) AS entry, max(CASE WHEN role = 'user' THEN turn END) AS header_turn, count_if(role = 'assistant') AS n_answers, md5(string_agg(text, ' ' ORDER BY turn)) AS body FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entry FROM conversations) WHERE entry > 0 GROUP BY conv_id, entry")
_b("context_features", "SELECT conv_id, turn, role, coalesce(lag(role) OVER w, 'BOS') AS prev_role, coalesce(lead(role) OVER w, 'EOS') AS next_role, right(text, 3) AS suffix, coalesce(left(lead(text) OVER w, 3), '') AS next_prefix FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
_b("first_occurrence_growth", "SELECT g, count_if(first_pos <= g) AS vocabulary FROM (SELECT l_partkey, min(l_orderkey) AS first_pos FROM {lineitem} GROUP BY l_partkey) CROSS JOIN (SELECT explode(array(100, 300, 1000, 3000, 10000)) AS g) GROUP BY g",
   "SELECT g, count_if(first_pos <= g) AS vocabulary FROM (SELECT l_partkey, min(l_orderkey) AS first_pos FROM lineitem GROUP BY l_partkey) CROSS JOIN (SELECT unnest([100, 300, 1000, 3000, 10000]) AS g) GROUP BY g")
_b("session_windows", "SELECT user_id, session_window.start AS start_ts, count(*) AS n FROM {events} GROUP BY user_id, session_window(ts, '30 minutes')",
   "SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, c")
_b("tumbling_windows", "SELECT window.start AS start_ts, event_type, count(*) AS n FROM {events} GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_ts, event_type, count(*) AS n FROM events GROUP BY 1, 2")


@_c.frame("anchored_cluster", """
WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, ts, ts AS anchor, 1 AS c FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.k, o.ts, CASE WHEN o.ts > r.anchor + INTERVAL 6 HOUR THEN o.ts ELSE r.anchor END, CASE WHEN o.ts > r.anchor + INTERVAL 6 HOUR THEN r.c + 1 ELSE r.c END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, max(c) AS clusters, count(*) AS n FROM r GROUP BY user_id""")
def anchored_cluster(spark, sf_dir):
    """Greedy clusters that open six hours after their first event: a fold over each user's sorted times."""
    times = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    state = lambda a, c: F.struct(a.alias("anchor"), c.alias("clusters"))
    folded = times.groupBy("user_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    far = lambda s, t: s["anchor"].isNull() | (t > s["anchor"] + 6 * 3_600_000_000)
    fold = F.aggregate("ts", state(F.lit(None).cast("long"), F.lit(0)), lambda s, t: state(F.when(far(s, t), t).otherwise(s["anchor"]), s["clusters"] + far(s, t).cast("int")))
    return folded.select("user_id", fold["clusters"].alias("clusters"), F.size("ts").cast("long").alias("n"))


@_c.frame("interval_cover")
def interval_cover(spark, sf_dir):
    """Greedy leftmost-longest cover of spans [ts, ts + value minutes) a user and day, as a fold."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.to_date("ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), "value", "event_id")
    from weftline.operators.spans import cover

    spans = e.select("user_id", "day", F.struct(F.col("s").alias("start"), (F.col("s") + F.round("value").cast("long") * 60_000_000).alias("end"), F.lit(0).alias("priority"), F.col("event_id").alias("id")).alias("span"))
    grouped = spans.groupBy("user_id", "day").agg(F.collect_list("span").alias("spans"))
    return grouped.select("user_id", "day", F.size("spans").alias("n"), F.size(cover(F.col("spans"))).alias("kept"))


QUERIES, SQL = _c.QUERIES, _c.SQL
