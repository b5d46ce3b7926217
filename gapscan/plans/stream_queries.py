"""Streams over event tables; their oracles are the batch folds in SQL."""

from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from ..streaming import streams as X
from .adapters import scratch
from .catalog import CATALOG
from .run_queries import _ACTIVE, _STALL, _STATES

add = CATALOG.add
#: Files of a batch: no task writes or reads a batch alone
FILES = 12


def _live(t, df, name, files_a_batch=None):
    """The rows as files that a stream follows."""
    path = scratch(t.spark, name)
    df.write.parquet(path)
    return X.follow(t.spark, df, path, files_a_batch)


def _in_batches(t, df, name, **end):
    """Rows with an event time ``ts`` as a stream of several batches: the earlier and the later half
    of the time in two folders of ``FILES`` each, the rows of a half dealt at random, so that events
    of a key come out of order within a batch and over batches.  The rows are worked out once."""
    df = cut_lineage(df)
    low, high = df.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return _live(t, df, name), "1 hour"
    path, middle = scratch(t.spark, name), F.lit(low + (high - low) / 2)
    for half in (F.col("ts") <= middle, F.col("ts") > middle):
        for part in (0, 1):
            dealt = df.filter(half & (F.pmod(F.xxhash64("ts", *end), F.lit(2)) == part))
            dealt.repartition(FILES).write.mode("append").parquet(path)
    _ended(df, **end).filter(F.col("ts") > F.lit(high)).coalesce(1).write.mode("append").parquet(path)
    return X.follow(t.spark, df, path, FILES), f"{(high - low).total_seconds() / 2 + 1:.0f} seconds"


def _ended(df, **others):
    """With a last row far behind the others: it moves the watermark past all of them, so
    what still waits is emitted, and stays waiting itself."""
    end = df.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).filter("ts IS NOT NULL")
    return df.unionByName(end.withColumns({c: F.lit(v).cast(dict(df.dtypes)[c]) for c, v in others.items()}), allowMissingColumns=True)


def _events(t):
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


def _target_state(t):
    events, delay = _in_batches(t, t("target_events").withColumn("ts", F.timestamp_seconds("sec")), "ev", run_id="end", target_id="end")
    out = X.run(X.stream_target_state(events, delay), scratch(t.spark, "t1"), mode="update")
    return X.latest(out, ["run_id", "target_id"], "n").drop("n")


add("t01_stream_target_state", _target_state, f"WITH {_STATES} SELECT * FROM states")


def _stalls(t):
    cycles, delay = _in_batches(t, t("cycle_events").withColumn("ts", F.timestamp_seconds(F.col("cycle") * 86400)), "cy", run_id="end")
    return X.run(X.stream_stall(cycles, delay=delay), scratch(t.spark, "t2"))


add(
    "t02_stream_stall", _stalls,
    f"""WITH {_STALL}, f AS (SELECT *, avg(CASE WHEN compile_failed THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY run_id ORDER BY cycle ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS fail_rate FROM stalls)
        SELECT run_id, cycle, stall_streak, stalled, fail_rate, CASE WHEN stalled THEN 'G8_STALL' WHEN fail_rate > 0.5 THEN 'G8_COMPILE_FAIL_RATE' ELSE 'PASS' END AS gate FROM f""",
)


def _cost(t):
    ledger = _events(t).select("ts", F.concat(F.lit("run"), (F.col("user_id") % 50).cast("string")).alias("run_id"), F.col("event_type").alias("role"), (F.col("event_id") % 500).alias("tokens"), (F.col("event_id") % 70).alias("micro_usd"))
    out = X.run(X.stream_cost(_live(t, ledger, "led")), scratch(t.spark, "t3"), mode="update")
    return X.latest(out, ["window_start", "run_id", "role"], "n").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "run_id", "role", "tokens", "micro_usd", "n")


add(
    "t03_stream_cost", _cost,
    """SELECT strftime(ts, '%Y-%m-%d') AS day, 'run' || CAST(user_id % 50 AS STRING) AS run_id, event_type AS role, CAST(SUM(event_id % 500) AS BIGINT) AS tokens, CAST(SUM(event_id % 70) AS BIGINT) AS micro_usd, count(*) AS n
       FROM events GROUP BY 1, 2, 3""",
)


def _sliding(t):
    ledger = _events(t).select("ts", F.concat(F.lit("run"), (F.col("user_id") % 50).cast("string")).alias("run_id"), F.lit("any").alias("role"), (F.col("event_id") % 500).alias("tokens"), (F.col("event_id") % 70).alias("micro_usd"))
    live, delay = _in_batches(t, ledger, "sld", run_id="end")
    out = X.run(X.stream_cost(live, "2 days", "1 day", delay), scratch(t.spark, "t3s"), mode="append").filter("run_id <> 'end'")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "run_id", "tokens", "micro_usd", "n")


add(
    "t03_stream_cost_sliding", _sliding,
    """WITH w AS (SELECT *, unnest([0, 1]) AS back FROM events)
       SELECT strftime(date_trunc('day', ts) - to_days(back), '%Y-%m-%d') AS day, 'run' || CAST(user_id % 50 AS STRING) AS run_id, CAST(SUM(event_id % 500) AS BIGINT) AS tokens, CAST(SUM(event_id % 70) AS BIGINT) AS micro_usd, count(*) AS n
       FROM w GROUP BY 1, 2""",
)


def _budget(t):
    clock, delay = _in_batches(t, t("clock_events").withColumn("ts", F.timestamp_seconds("sec")), "clk", run_id="end")
    return X.run(X.stream_budget(clock, delay=delay), scratch(t.spark, "t4"))


add(
    "t04_stream_budget", _budget,
    f"""WITH {_ACTIVE}, s AS (SELECT *, lead(sec) OVER w AS nxt, last_value(CASE WHEN kind IN ('pause', 'resume') THEN kind END IGNORE NULLS) OVER w AS held FROM a WINDOW w AS (PARTITION BY run_id ORDER BY sec, seq)),
        c AS (SELECT run_id, sec + 601 - active_seconds AS hit, CAST(601 AS BIGINT) AS active_seconds, cycles, 'minutes' AS reason FROM s
              WHERE coalesce(held, 'resume') <> 'pause' AND active_seconds <= 600 AND (nxt IS NULL OR nxt >= sec + 601 - active_seconds)
              UNION ALL SELECT run_id, sec, active_seconds, cycles, 'cycles' FROM s WHERE cycles > 20)
        SELECT run_id, hit AS sec, active_seconds, cycles, reason FROM c QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY hit, CASE reason WHEN 'minutes' THEN 0 ELSE 1 END, cycles) = 1""",
)


def _handoff(t):
    q = _events(t).filter("event_type = 'view'").select(F.col("event_id").alias("req_id"), F.col("user_id").alias("key"), "ts")
    a = _events(t).filter("event_type = 'purchase'").select(F.col("event_id").alias("resp_id"), F.col("user_id").alias("key"), "ts")
    live = _live(t, _ended(q, req_id=-1, key=-1), "q"), _live(t, _ended(a, resp_id=-1, key=-2), "a")
    return X.run(X.stream_handoff(*live, "1 DAY"), scratch(t.spark, "t5")).select("req_id", "resp_id")


add(
    "t05_stream_handoff", _handoff,
    """SELECT q.event_id AS req_id, a.event_id AS resp_id FROM events q LEFT JOIN events a ON a.event_type = 'purchase' AND a.user_id = q.user_id AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL 1 DAY
       WHERE q.event_type = 'view'""",
)


def _quarantine(t):
    rules = [("value", "value < 50"), ("type", "event_type <> 'error'")]
    _, bad = X.stream_quarantine(_live(t, _events(t), "rows"), rules, scratch(t.spark, "t6"))
    return bad.select("event_id", "broken")


add(
    "t06_stream_quarantine", _quarantine,
    """SELECT * FROM (SELECT event_id, concat_ws(',', CASE WHEN NOT coalesce(value < 50, FALSE) THEN 'value' END, CASE WHEN event_type = 'error' THEN 'type' END) AS broken FROM events) WHERE broken <> ''""",
)


def _new_failures(t):
    rows = _events(t).filter("event_type = 'error'").select("ts", F.col("user_id").alias("target_id"), (F.col("event_id") % 4).alias("signature"))
    return X.run(X.stream_new_failures(_live(t, rows, "f"), "60 days"), scratch(t.spark, "t7")).select("target_id", "signature")


add("t07_stream_new_failures", _new_failures, "SELECT DISTINCT user_id AS target_id, event_id % 4 AS signature FROM events WHERE event_type = 'error'")


def _sessions(t):
    clock = _events(t).select("ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"))
    out = X.run(X.stream_wait_sessions(_live(t, _ended(clock, run_id="end"), "c")), scratch(t.spark, "t8"))
    return out.select("run_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


add(
    "t08_stream_wait_sessions", _sessions,
    """WITH g AS (SELECT 'u' || CAST(user_id AS STRING) AS run_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       i AS (SELECT *, SUM(s) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT run_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM i GROUP BY run_id, k""",
)
