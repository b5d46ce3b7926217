"""The same folds as Structured Streaming jobs over live events.

Each function takes a streaming DataFrame and returns one; ``run`` starts it with
``availableNow`` on a checkpoint in the shared folder and reads back what it wrote.
State processors keep a few numbers a key.  Events come in any order, within a batch and over
batches: they wait in state until the watermark passes them, then a timer folds them in event
order.  What comes later than the watermark is dropped by Spark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Config
from ..operators.lineage import importable
from ..operators.telemetry import TERMINAL

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(stream: DataFrame, path: str, *, mode: str = "append") -> DataFrame:
    """Process what is there, exactly once; ``path`` holds the output and the checkpoint."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema, out = stream.schema, f"{path}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:  # updates are kept batch by batch; a batch run again replaces itself
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n:09d}")).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("basePath", out).option("recursiveFileLookup", True).parquet(out)


def latest(updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last update of each key."""
    whole = F.struct(*[c for c in updates.columns if c not in keys])
    return updates.groupBy(*keys).agg(F.max_by(whole, version).alias("x")).select(*keys, "x.*")


class _InOrder(StatefulProcessor):
    """A fold over a key's events in the order of ``order``, whatever order they come in.

    Events wait in a list; one timer stands at the earliest of them, or at what ``due`` says.
    When the watermark passes it, all events behind the watermark are folded."""

    state_schema, start = "", ()
    row_schema, out_schema = "", ""
    order = ("ms",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.names = [f.split()[0] for f in self.row_schema.split(", ")]
        self.kinds = [_KINDS[f.split()[1]] for f in self.row_schema.split(", ")]
        self.by = [self.names.index(c) for c in self.order]

    def close(self) -> None:
        pass

    def fold(self, key: tuple, state: tuple, rows: list[tuple], now: int) -> tuple[tuple | None, list[tuple]]:
        """The state behind ``rows`` at ``now`` (None drops it), and rows to emit."""
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When something is to be done although no event comes."""
        return None

    def _wake(self, now: int, *times: int | None) -> None:
        """A timer at the first of ``times``, unless one stands that ``now`` has not passed:
        those it has are still listed while they are worked off."""
        at = min((t for t in times if t is not None), default=None)
        if at is not None and not any(now < t <= at for t in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in self.out_schema.split(", ")])

    def handleInputRows(self, key, rows, timerValues):
        came = []
        for pdf in rows:  # pandas has floats where a number is null, and NaN is not itself
            columns = [[None if x is None or x != x else k(x) for x in pdf[n].tolist()] for n, k in zip(self.names, self.kinds, strict=True)]
            came.extend(zip(*columns, strict=True))
        self.waiting.appendList(came)
        self._wake(timerValues.getCurrentWatermarkInMs(), min(r[0] for r in came))
        return iter(())  # an empty frame a key would cost more than the key

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in held if r[0] <= now), key=lambda r: [r[i] for i in self.by])
        left = [r for r in held if r[0] > now]
        state, out = self.fold(tuple(key), tuple(self.state.get()) if self.state.exists() else self.start, ready, now)
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if state is None and not left:
            self.state.clear()
        else:
            state = self.start if state is None else state
            self.state.update(state)
            self._wake(now, min((r[0] for r in left), default=None), self.due(state))
        if out:
            yield self._out(out)


_KINDS = {"long": int, "string": str, "boolean": bool}


def _fold(events: DataFrame, keys: list[str], processor: _InOrder, delay: str, mode: str) -> DataFrame:
    """``processor`` over ``events`` by ``keys``; ``ts`` is the event time."""
    importable(events.sparkSession)
    timed = events.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=processor.out_schema, outputMode=mode, timeMode="EventTime")


class TargetState(_InOrder):
    state_schema, start = "status string, rounds long, n long, last long", ("", 0, 0, 0)
    row_schema, order = "ms long, seq long, status string", ("ms", "seq")
    out_schema = "run_id string, target_id string, status string, repair_rounds long, n long"

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def due(self, state):
        return state[3] + self.keep_ms if state[0] in TERMINAL else None

    def fold(self, key, state, rows, now):
        status, rounds, n, last = state
        if not rows:  # an ended target's time is up
            return (None if status in TERMINAL and now >= last + self.keep_ms else state), []
        for ms, _, s in rows:
            n, last = n + 1, ms
            if status not in TERMINAL:
                rounds += s == "REPAIR_REQUESTED"
                status = s
        return (status, rounds, n, last), [(*key, status, rounds, n)]


def stream_target_state(events: DataFrame, delay: str = "1 hour", keep_ended_days: float = 30) -> DataFrame:
    """T-1: the state of each target; a terminal state is never left.  ``events``: run_id,
    target_id, ts, seq, status.  Update mode.  State of a target that ended and was silent
    for ``keep_ended_days`` is dropped; an event after that would begin it anew."""
    return _fold(events, ["run_id", "target_id"], TargetState(int(keep_ended_days * 86_400_000)), delay, "Update")


class Stall(_InOrder):
    state_schema, start = "streak long, window string", (0, "")
    row_schema, order = "ms long, cycle long, lines_delta long, branches_delta long, compile_failed boolean", ("ms", "cycle")
    out_schema = "run_id string, cycle long, stall_streak long, stalled boolean, fail_rate double, gate string"

    def __init__(self, config: Config = DEFAULT):
        self.config = config

    def fold(self, key, state, rows, now):
        streak, window = state
        out = []
        for _, cycle, lines, branches, failed in rows:
            if lines is not None and branches is not None:
                streak = streak + 1 if lines == 0 and branches == 0 else 0
            window = (window + ("1" if failed else "0"))[-self.config.fail_window :]
            rate = window.count("1") / len(window)
            stalled = streak >= self.config.stall_cycles
            gate = "G8_STALL" if stalled else "G8_COMPILE_FAIL_RATE" if rate > self.config.fail_rate else "PASS"
            out.append((key[0], cycle, streak, stalled, rate, gate))
        return (streak, window), out


def stream_stall(cycles: DataFrame, config: Config = DEFAULT, delay: str = "1 hour") -> DataFrame:
    """T-2: stall streak and compile failures of each cycle, once the watermark has passed it.
    ``cycles``: run_id, ts, cycle, lines_delta, branches_delta, compile_failed."""
    return _fold(cycles, ["run_id"], Stall(config), delay, "Append")


def stream_cost(ledger: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """T-3: tokens and micro-dollars of each run and role in tumbling (or sliding) windows;
    rows later than the watermark are dropped.  ``ledger``: ts, run_id, role, tokens, micro_usd."""
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    summed = ledger.withWatermark("ts", delay).groupBy(frame.alias("w"), "run_id", "role").agg(
        F.sum("tokens").alias("tokens"), F.sum("micro_usd").alias("micro_usd"), F.count(F.lit(1)).alias("n")
    )
    return summed.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "run_id", "role", "tokens", "micro_usd", "n")


class Budget(_InOrder):
    state_schema, start = "start long, paused long, closed long, cycles long, alerted boolean", (-1, -1, 0, 0, False)
    row_schema, order = "ms long, seq long, kind string", ("ms", "seq")
    out_schema = "run_id string, sec long, active_seconds long, cycles long, reason string"

    def __init__(self, config: Config = DEFAULT):
        self.config = config

    def _over(self, state) -> int | None:
        """The first second beyond the minutes, if the clock runs on until then."""
        start, paused, closed, _, alerted = state
        return None if start < 0 or paused >= 0 or alerted else start + closed + 60 * self.config.max_minutes + 1

    def due(self, state):
        over = self._over(state)
        return None if over is None else 1000 * over

    def fold(self, key, state, rows, now):
        out = []

        def check(state: tuple, sec: int) -> tuple:
            over = self._over(state)
            if over is not None and sec >= over:
                out.append((key[0], over, 60 * self.config.max_minutes + 1, state[3], "minutes"))
                return (*state[:4], True)
            return state

        for ms, _, kind in rows:
            sec = ms // 1000
            start, paused, closed, cycles, alerted = check(state, sec)
            start = sec if start < 0 else start
            if kind == "pause" and paused < 0:
                paused = sec
            elif kind == "resume" and paused >= 0:
                closed, paused = closed + sec - paused, -1
            cycles += kind == "cycle"
            if not alerted and cycles > self.config.max_cycles:
                alerted = True
                out.append((key[0], sec, (paused if paused >= 0 else sec) - start - closed, cycles, "cycles"))
            state = (start, paused, closed, cycles, alerted)
        return check(state, now // 1000), out


def stream_budget(clock: DataFrame, config: Config = DEFAULT, delay: str = "1 hour") -> DataFrame:
    """T-4: one alert a run: at the second its running minutes pass their limit, though no
    event comes then, or at the event that takes it over its cycles.  ``clock``: run_id,
    ts, seq, kind (pause, resume, cycle or any other)."""
    return _fold(clock, ["run_id"], Budget(config), delay, "Append")


def stream_handoff(requests: DataFrame, responses: DataFrame, timeout: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """T-5: each request with its responses within the timeout; without one, NULL.
    ``requests``: req_id, key, ts; ``responses``: resp_id, key, ts."""
    q = requests.withWatermark("ts", delay).select("req_id", F.col("key").alias("q_key"), F.col("ts").alias("q_ts"))
    a = responses.withWatermark("ts", delay).select("resp_id", F.col("key").alias("a_key"), F.col("ts").alias("a_ts"))
    within = F.expr(f"q_key = a_key AND a_ts >= q_ts AND a_ts <= q_ts + INTERVAL {timeout}")
    return q.join(a, within, "leftOuter").select("req_id", "resp_id", "q_ts")


def stream_quarantine(rows: DataFrame, rules: list[tuple[str, str]], path: str) -> tuple[DataFrame, DataFrame]:
    """T-6: rows that meet every rule, and the others with the names of those they break;
    both written batch by batch, a batch run again replaces itself."""
    spark = rows.sparkSession
    broken = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules])), ",")
    marked = rows.withColumn("broken", broken)

    def split(df: DataFrame, n: int) -> None:
        df.filter("broken = ''").drop("broken").write.mode("overwrite").parquet(f"{path}/good/batch={n:09d}")
        df.filter("broken <> ''").write.mode("overwrite").parquet(f"{path}/bad/batch={n:09d}")

    query = marked.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(split).start()
    query.awaitTermination()
    read = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/{name}")
    return read("good", rows.schema), read("bad", marked.schema)


def stream_new_failures(failures: DataFrame, delay: str = "2 days") -> DataFrame:
    """T-7: a failure signature of a target once within the watermark."""
    return failures.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["target_id", "signature"])


def stream_wait_sessions(clock: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """T-8: sessions of events of each run, parted by gaps."""
    grouped = clock.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "run_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("run_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def follow(spark: SparkSession, table: DataFrame, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream over a table of files that something else writes."""
    reader = spark.readStream.schema(table.schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)
