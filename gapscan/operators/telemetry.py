"""Cost ledgers, run history and convergence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

#: USD per million tokens in and out, by a part of the model's name (fixed values)
PRICES = [
    ("opus", 15.00, 75.00),
    ("sonnet", 3.00, 15.00),
    ("haiku", 0.80, 4.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4.1-mini", 0.40, 1.60),
    ("gpt-4.1", 2.00, 8.00),
    ("o3", 2.00, 8.00),
]
FALLBACK_PRICE = (15.00, 75.00)


def price_table(spark: SparkSession, overrides: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """U-2: the price table, single keys replaced or added."""
    rows = {k: (i, o) for k, i, o in PRICES} | (overrides or {})
    return spark.createDataFrame([(k, float(i), float(o)) for k, (i, o) in rows.items()], "key string, price_in double, price_out double")


def with_cost(interactions: DataFrame, prices: DataFrame, fallback: tuple[float, float] = FALLBACK_PRICE) -> DataFrame:
    """P-11: the longest key within the lower-cased model sets the price; an unknown model
    costs the most.  The few keys become one sorted array, looked up per distinct model
    expression without a join on the ledger."""
    keys = prices.agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.length("key").alias("n"), "key", "price_in", "price_out")))).alias("__keys"))
    model = F.lower(F.coalesce("model", F.lit("")))
    other = F.struct(F.lit(0).alias("n"), F.lit("").alias("key"), F.lit(fallback[0]).alias("price_in"), F.lit(fallback[1]).alias("price_out"))
    hit = F.coalesce(F.get(F.filter("__keys", lambda k: model.contains(k["key"])), 0), other)
    priced = interactions.join(F.broadcast(keys), F.lit(True)).withColumn("__hit", hit)
    exact = lambda n, price: F.col(n).cast("decimal(18,0)") * F.col(f"__hit.{price}").cast("decimal(10,4)")
    # decimal, half to even: a float would round exact halves by chance
    micro = F.bround(exact("tokens_in", "price_in") + exact("tokens_out", "price_out"), 0).cast("long")
    return priced.withColumn("cost_usd", micro / 1e6).drop("__keys", "__hit")


def _micro() -> Column:
    """Costs as whole micro-dollars, so that sums do not depend on order."""
    return F.bround(F.col("cost_usd") * 1e6, 0).cast("long")


def cost_rollup(costed: DataFrame) -> DataFrame:
    """A-5: per run, role and round, per run and role, and per run."""
    label = F.when(F.bool_or("estimated"), "size_estimate").otherwise("api_usage")
    return (
        costed.withColumn("__micro", _micro()).rollup("run_id", "role", "round")
        .agg(
            F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), (F.sum("__micro") / 1e6).alias("cost_usd"),
            F.count(F.lit(1)).alias("n"), label.alias("source"),
        )
        .filter(F.col("run_id").isNotNull())
    )


def running_cost(costed: DataFrame, order: list[str]) -> DataFrame:
    """W-14: cumulative tokens, cost and duration in arrival order."""
    so_far = Window.partitionBy("run_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return costed.withColumn("__micro", _micro()).select(
        *costed.columns, F.sum("tokens_in").over(so_far).alias("total_in"), F.sum("tokens_out").over(so_far).alias("total_out"),
        (F.sum("__micro").over(so_far) / 1e6).alias("total_usd"), F.sum("duration_ms").over(so_far).alias("total_ms"),
    )


def distribute(shares: DataFrame, group: list[str], order: list[str], total: str = "total", weight: str = "weight") -> DataFrame:
    """W-9: split a whole number in proportion to weights, rounding half to even; the last
    item takes what is left, at least 0; equal parts where all weights are 0."""
    whole, line = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(*order)
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0))
    sums, n = F.sum(w).over(whole), F.count(F.lit(1)).over(whole)
    part = F.bround(F.col(total) * F.when(sums > 0, w / sums).otherwise(1.0 / n), 0).cast("long")
    rows = shares.withColumn("__part", part).withColumn("__last", F.row_number().over(line) == n)
    before = F.coalesce(F.sum("__part").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.when(F.col("__last"), F.greatest(F.lit(0), F.col(total) - before)).otherwise(F.col("__part"))
    return rows.withColumn("share", share.cast("long")).drop("__part", "__last")


#: Target state to bucket (fixed values)
BUCKETS = {
    "PENDING": "pending", "GENERATION_REQUESTED": "pending", "GENERATED": "generated", "APPLIED": "generated", "REPAIR_REQUESTED": "generated", "REPAIRED": "generated",
    "SKIPPED": "skipped", "PASSED": "passed", "ABANDONED": "abandoned",
    "GENERATION_FAILED": "failed", "PATCH_FAILED": "failed", "COMPILE_FAILED": "failed", "TEST_FAILED": "failed",
}
TERMINAL = ("PASSED", "SKIPPED", "ABANDONED")
BUCKET_NAMES = ("pending", "generated", "passed", "failed", "skipped", "abandoned")


def current_states(events: DataFrame) -> DataFrame:
    """The state of each target after all events: a terminal state is never left, else
    the last event counts.  A fold as one aggregate: the first terminal event if there is
    one, otherwise the latest event.  ``repair_rounds``: all requests, less those that a
    second aggregate counts from the end on; nothing is gathered."""
    keys, ends, asked = ["run_id", "target_id"], F.col("status").isin(*TERMINAL), F.col("status") == "REPAIR_REQUESTED"
    first_end = F.min(F.when(ends, F.struct("sec", "seq", "status")))
    last = F.max(F.struct("sec", "seq", "status"))
    folded = events.groupBy(*keys).agg(first_end.alias("e"), last.alias("l"), F.count_if(asked).alias("n"))
    over = events.filter(ends).groupBy(*keys).agg(F.min(F.struct("sec", "seq")).alias("end"))
    late = events.filter(asked).join(over.hint("merge"), keys).filter(F.struct("sec", "seq") >= F.col("end")).groupBy(*keys).agg(F.count(F.lit(1)).alias("late"))
    rows = folded.join(late.hint("merge"), keys, "left")
    return rows.select(*keys, F.coalesce("e.status", "l.status").alias("status"), (F.col("n") - F.coalesce("late", F.lit(0))).alias("repair_rounds"))


def manifest_totals(states: DataFrame) -> DataFrame:
    """A-6: targets of each bucket per run, zeros kept; an unknown state is pending."""
    table = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])
    bucket = F.coalesce(F.try_element_at(table, F.col("status")), F.lit("pending"))
    return states.withColumn("bucket", bucket).groupBy("run_id").pivot("bucket", list(BUCKET_NAMES)).count().fillna(0, list(BUCKET_NAMES))


def repair_stats(events: DataFrame) -> DataFrame:
    """A-13: hits by rule and by model, tokens, and the share of rules."""
    by_rule, by_model = F.count_if(F.col("by") == "rule"), F.count_if(F.col("by") == "llm")
    rate = F.coalesce(F.try_divide(by_rule.cast("double"), (by_rule + by_model).cast("double")), F.lit(0.0))
    return events.groupBy("run_id").agg(
        by_rule.alias("rule_hits"), by_model.alias("llm_hits"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.bround(rate, 6).alias("rule_rate")
    )


def cycle_outcomes(tests: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A-14: generated and discarded tests of each cycle, reasons, classes, evidence."""
    kept = F.col("discard_reason").isNull()
    reasons = tests.filter(~kept).groupBy("cycle", "discard_reason").count()
    histogram = reasons.groupBy("cycle").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("discard_reason", "count"))), lambda x: F.concat(x["discard_reason"], F.lit("="), x["count"].cast("string"))), ",").alias("reasons")
    )
    counted = tests.groupBy("cycle").agg(
        F.count_if(kept).alias("generated"), F.count_if(~kept).alias("discarded"), F.array_join(F.array_sort(F.collect_set("sut")), ",").alias("suts"),
    )
    # the first few ids are picked before any are gathered
    nth = F.row_number().over(Window.partitionBy("cycle").orderBy("evidence_id"))
    few = tests.filter("evidence_id IS NOT NULL").select("cycle", "evidence_id").distinct().withColumn("__n", nth).filter(F.col("__n") <= config.evidence_kept)
    evidence = few.groupBy("cycle").agg(F.array_join(F.array_sort(F.collect_list("evidence_id")), ",").alias("evidence_ids"))
    rows = counted.join(evidence, "cycle", "left").join(histogram, "cycle", "left")
    return rows.withColumn("reasons", F.coalesce("reasons", F.lit(""))).withColumn("evidence_ids", F.coalesce("evidence_ids", F.lit("")))


def majority(df: DataFrame, col: str, group: list[str] | None = None) -> DataFrame:
    """A-15: the most frequent value that is neither null nor ``unknown``; of equals the
    smallest; ``unknown`` without any."""
    group = group or []
    named = F.when(F.col(col) != "unknown", F.col(col))
    counts = df.groupBy(*group, named.alias("v")).count()
    best = F.min_by(F.col("v"), F.when(F.col("v").isNotNull(), F.struct(-F.col("count"), F.col("v"))))
    return counts.groupBy(*group).agg(F.coalesce(best, F.lit("unknown")).alias(f"majority_{col}"))


def token_budget(packs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A-16: tokens of each pack by its bytes, and whether that is over the ceiling."""
    tokens = F.floor(F.col("bytes") * config.tokens_per_byte).cast("long")
    return packs.withColumn("tokens", tokens).withColumn("over_budget", F.col("tokens") > config.pack_ceiling)


def token_budget_totals(budgeted: DataFrame, group: str) -> DataFrame:
    return budgeted.groupBy(group).agg(
        F.count(F.lit(1)).alias("packs"), F.sum("tokens").alias("tokens"), F.count_if("over_budget").alias("over"), F.max("tokens").alias("largest")
    )


#: Directories that are no workspace (fixed values)
EXCLUDED_DIRS = (
    ".git", "node_modules", "target", "build", "dist", "out",
    ".idea", ".gradle", ".mvn", "__pycache__", ".pytest_cache",
    ".venv", "venv", ".claude",
)


def workspace_size(files: DataFrame, group: str = "repo") -> DataFrame:
    """A-18: bytes outside excluded directories at any level."""
    dirs = F.split("path", "/")
    inside = F.slice(dirs, 1, F.size(dirs) - 1)
    kept = files.filter(~F.arrays_overlap(inside, F.array(*[F.lit(d) for d in EXCLUDED_DIRS])))
    return kept.groupBy(group).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def cost_efficiency(sizes: DataFrame, ledger: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A-17: what sending the whole workspace with every call would have cost.  ``sizes``
    (repo, bytes) and ``ledger`` (repo, calls, tokens, cost_usd, estimated, sent_bytes) have
    one row a repository; without bytes sent the byte factor is 0."""
    both = sizes.join(ledger, "repo")
    baseline = F.ceil(F.col("bytes") / config.chars_per_token) * F.col("calls")
    saved = F.greatest(F.lit(0), baseline - F.col("tokens"))
    blended = F.try_divide(F.col("cost_usd"), F.col("tokens").cast("double"))
    return both.select(
        "repo", baseline.cast("long").alias("baseline_tokens"), F.col("tokens").alias("actual_tokens"), saved.cast("long").alias("saved_tokens"),
        F.bround(F.try_divide(baseline.cast("double"), F.col("tokens").cast("double")), 4).alias("factor"),
        F.bround(F.coalesce(F.try_divide(saved * 100.0, baseline.cast("double")), F.lit(0.0)), 2).alias("savings_pct"),
        F.bround(F.coalesce(F.try_divide((F.col("bytes") * F.col("calls")).cast("double"), F.col("sent_bytes").cast("double")), F.lit(0.0)), 4).alias("byte_factor"),
        F.bround(saved * blended, 6).alias("saved_usd"), F.when(F.col("estimated"), "size_estimate").otherwise("api_usage").alias("source"),
    )


def batch_decision(outcomes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A-24: continue, repair first or stop each batch, and why.  ``outcomes``: batch_id, status (passed,
    failed, needs_context), global_error."""
    counted = outcomes.groupBy("batch_id").agg(
        F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") != "needs_context").alias("effective"),
        F.coalesce(F.bool_or("global_error"), F.lit(False)).alias("global_error"),
    )
    rate = F.coalesce(F.try_divide(F.col("passed").cast("double"), F.col("effective").cast("double")), F.lit(1.0))
    repair, go = "REPAIR_THEN_CONTINUE", "CONTINUE"
    steps = [
        (F.col("global_error"), repair, "GLOBAL_COMPILE_ERROR"), (F.col("effective") == 0, go, "ALL_NEED_MORE_CONTEXT"), (F.col("passed") == F.col("effective"), go, "ALL_PASSED"),
        (rate >= config.advance_high, repair, "REPAIR_FAILURES"), (rate >= config.advance_low, repair, "REPAIR_FIRST"),
    ]
    action, reason = F.lit("STOP"), F.lit("TOO_MANY_FAILURES")
    for condition, what, why in reversed(steps):
        action, reason = F.when(condition, what).otherwise(action), F.when(condition, why).otherwise(reason)
    return counted.select("*", F.bround(rate, 6).alias("rate"), action.alias("decision"), reason.alias("reason"))


def pack_self_assessment(responses: DataFrame, col: str) -> DataFrame:
    """A-29."""
    bucket = F.coalesce(F.when(F.trim(F.col(col)) != "", F.upper(F.trim(F.col(col)))), F.lit("UNKNOWN"))
    return responses.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def stall_streak(cycles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """W-7: consecutive measured flat cycles.  Progress starts a new island; a cycle
    without a measure neither counts nor resets."""
    order = Window.partitionBy("run_id").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    measured = F.col("lines_delta").isNotNull() & F.col("branches_delta").isNotNull()
    flat = measured & (F.col("lines_delta") == 0) & (F.col("branches_delta") == 0)
    rows = cycles.withColumn("__flat", flat.cast("long")).withColumn("__island", F.sum((measured & ~flat).cast("long")).over(order))
    island = Window.partitionBy("run_id", "__island").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    streak = F.coalesce(F.sum("__flat").over(island), F.lit(0)).cast("long")
    return rows.withColumn("stall_streak", streak).withColumn("stalled", F.col("stall_streak") >= config.stall_cycles).drop("__flat", "__island")


def compile_fail_window(cycles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """W-8: the share of failed compiles among the last cycles, and which gate speaks."""
    last = Window.partitionBy("run_id").orderBy("cycle").rowsBetween(1 - config.fail_window, 0)
    rated = stall_streak(cycles, config).withColumn("fail_rate", F.avg(F.col("compile_failed").cast("double")).over(last))
    gate = F.when(F.col("stalled"), "G8_STALL").when(F.col("fail_rate") > config.fail_rate, "G8_COMPILE_FAIL_RATE").otherwise("PASS")
    return rated.withColumn("gate", gate)


def dynamic_batch_size(cycles: DataFrame, base: int = 5, most: int = 10, slow_most: int = 3) -> DataFrame:
    """W-12: the size of a cycle's batch, from the cycles before it: a fail rate above 0.3
    in the last one halves the base (at least 2); gains in each of the last two without a
    failure add 2, up to ``most``; a slow module gets at most ``slow_most``.
    ``cycles``: run_id, cycle, fail_rate, delta, slow."""
    order = Window.partitionBy("run_id").orderBy("cycle")
    good = (F.col("delta") > 0) & (F.col("fail_rate") == 0)
    both = F.coalesce(F.lag(good, 1).over(order) & F.lag(good, 2).over(order), F.lit(False))
    size = F.when(F.lag("fail_rate").over(order) > 0.3, max(2, base // 2)).when(both, min(base + 2, most)).otherwise(base)
    return cycles.withColumn("batch_size", F.when(F.col("slow"), F.least(size, F.lit(slow_most))).otherwise(size))


def retain_cycles(patches: DataFrame, summaries: DataFrame, keep: int) -> DataFrame:
    """W-15: drop rows at or below the (keep+1)-th latest summarised cycle."""
    ranked = summaries.select("run_id", "cycle").distinct().withColumn("__r", F.dense_rank().over(Window.partitionBy("run_id").orderBy(F.desc("cycle"))))
    cut = ranked.filter(F.col("__r") == keep + 1).select("run_id", F.col("cycle").alias("__cut"))
    return patches.join(cut, "run_id", "left").filter(F.col("__cut").isNull() | (F.col("cycle") > F.col("__cut"))).drop("__cut")


def elapsed_active(clock: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """W-17: seconds from a run's first event to each of its events, pauses excluded.  Of
    repeated pauses the first counts, a resume without pause does nothing, an open pause
    freezes the clock."""
    order = Window.partitionBy("run_id").orderBy("sec", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("kind").isin("pause", "resume"), F.col("kind"))
    rows = clock.withColumn("__before", F.last(mark, True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    starts = (F.col("kind") == "pause") & (F.coalesce("__before", F.lit("resume")) != "pause")
    ends = (F.col("kind") == "resume") & (F.col("__before") == "pause")
    rows = rows.withColumn("__opened", F.last(F.when(starts, F.col("sec")), True).over(so_far)).withColumn("__ends", F.coalesce(ends, F.lit(False)))
    closed = F.coalesce(F.sum(F.when(F.col("__ends"), F.col("sec") - F.col("__opened"))).over(so_far), F.lit(0))
    now = F.last(mark, True).over(so_far) == "pause"
    open_ = F.when(F.coalesce(now, F.lit(False)), F.col("sec") - F.col("__opened")).otherwise(0)
    active = F.col("sec") - F.first("sec").over(so_far) - closed - open_
    cycles = F.coalesce(F.sum((F.col("kind") == "cycle").cast("long")).over(so_far), F.lit(0))
    return rows.withColumn("active_seconds", active.cast("long")).withColumn("cycles", cycles.cast("long")).select(
        *clock.columns, "active_seconds", "cycles", ((F.col("active_seconds") > 60 * config.max_minutes) | (F.col("cycles") > config.max_cycles)).alias("over_budget")
    )
