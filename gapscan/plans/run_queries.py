"""Cost, run history and convergence."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import telemetry as T
from .catalog import CATALOG

add = CATALOG.add

_COSTED = """
    costed AS (
        SELECT * EXCLUDE (m, pi, po, x, q), CAST(q + CASE WHEN x % 100 > 50 OR (x % 100 = 50 AND q % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) / 1e6 AS cost_usd FROM (
            SELECT *, tokens_in * pi + tokens_out * po AS x, (tokens_in * pi + tokens_out * po) // 100 AS q FROM (
            SELECT *, CASE WHEN m LIKE '%gpt-4.1-mini%' THEN 40 WHEN m LIKE '%gpt-4o-mini%' THEN 15 WHEN m LIKE '%gpt-4.1%' THEN 200 WHEN m LIKE '%sonnet%' THEN 300
                   WHEN m LIKE '%gpt-4o%' THEN 250 WHEN m LIKE '%haiku%' THEN 80 WHEN m LIKE '%opus%' THEN 1500 WHEN m LIKE '%o3%' THEN 200 ELSE 1500 END AS pi,
                   CASE WHEN m LIKE '%gpt-4.1-mini%' THEN 160 WHEN m LIKE '%gpt-4o-mini%' THEN 60 WHEN m LIKE '%gpt-4.1%' THEN 800 WHEN m LIKE '%sonnet%' THEN 1500
                   WHEN m LIKE '%gpt-4o%' THEN 1000 WHEN m LIKE '%haiku%' THEN 400 WHEN m LIKE '%opus%' THEN 7500 WHEN m LIKE '%o3%' THEN 800 ELSE 7500 END AS po
            FROM (SELECT *, lower(coalesce(model, '')) AS m FROM interactions)))
    )"""


def _costed(t):
    return T.with_cost(t("interactions"), T.price_table(t.spark))


def _ordered(t):
    return _costed(t).withColumn("key", F.concat_ws("|", F.lpad(F.col("round").cast("string"), 6, "0"), "role", F.lpad(F.col("tokens_in").cast("string"), 9, "0")))


add(
    "p11_cost_usd", _costed,
    f"WITH {_COSTED} SELECT run_id, target_id, role, round, tokens_in, tokens_out, model, estimated, duration_ms, CAST(cost_usd AS DOUBLE) AS cost_usd FROM costed",
)
add(
    "a05_cost_rollup", lambda t: T.cost_rollup(_costed(t)),
    f"""WITH {_COSTED} SELECT run_id, role, round, CAST(SUM(tokens_in) AS BIGINT) AS tokens_in, CAST(SUM(tokens_out) AS BIGINT) AS tokens_out,
        CAST(SUM(CAST(round_even(cost_usd * 1e6, 0) AS BIGINT)) AS BIGINT) / 1e6 AS cost_usd, count(*) AS n, CASE WHEN bool_or(estimated) THEN 'size_estimate' ELSE 'api_usage' END AS source
        FROM costed GROUP BY ROLLUP (run_id, role, round) HAVING run_id IS NOT NULL""",
)
add(
    "w14_running_cost",
    lambda t: T.running_cost(_ordered(t), ["key"]).groupBy("run_id", "key").agg(*[F.max(c).alias(c) for c in ("total_in", "total_out", "total_usd", "total_ms")]),
    f"""WITH {_COSTED}, k AS (SELECT *, lpad(CAST(round AS STRING), 6, '0') || '|' || role || '|' || lpad(CAST(tokens_in AS STRING), 9, '0') AS key FROM costed),
        r AS (SELECT run_id, key, SUM(tokens_in) OVER w AS ti, SUM(tokens_out) OVER w AS tto, SUM(CAST(round_even(cost_usd * 1e6, 0) AS BIGINT)) OVER w AS u, SUM(duration_ms) OVER w AS d
              FROM k WINDOW w AS (PARTITION BY run_id ORDER BY key ROWS UNBOUNDED PRECEDING))
        SELECT run_id, key, CAST(max(ti) AS BIGINT) AS total_in, CAST(max(tto) AS BIGINT) AS total_out, CAST(max(u) AS BIGINT) / 1e6 AS total_usd, CAST(max(d) AS BIGINT) AS total_ms FROM r GROUP BY 1, 2""",
)
add(
    "w09_distribute",
    lambda t: T.distribute(
        t("targets").select("sut", "pos", F.col("missed_lines").alias("weight"), (F.length("sut") * 37 + 1).cast("long").alias("total")), ["sut"], ["pos"]
    ),
    """WITH s AS (SELECT sut, pos, missed_lines AS weight, CAST(length(sut) * 37 + 1 AS BIGINT) AS total FROM targets),
       p AS (SELECT *, SUM(weight) OVER (PARTITION BY sut) AS ws, count(*) OVER (PARTITION BY sut) AS n, row_number() OVER (PARTITION BY sut ORDER BY pos) AS rn FROM s),
       q AS (SELECT *, CAST(round_even(total * CASE WHEN ws > 0 THEN CAST(weight AS DOUBLE) / CAST(ws AS DOUBLE) ELSE 1.0::DOUBLE / n END, 0) AS BIGINT) AS part FROM p)
       SELECT sut, pos, weight, total, CAST(CASE WHEN rn = n THEN greatest(0, total - coalesce(SUM(part) OVER (PARTITION BY sut ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              ELSE part END AS BIGINT) AS share FROM q""",
)
_STATES = """
    e AS (SELECT *, status IN ('PASSED', 'SKIPPED', 'ABANDONED') AS fin FROM target_events),
    cut AS (SELECT run_id, target_id, min(sec * 100000000 + seq) FILTER (fin) AS c, max(sec * 100000000 + seq) AS l FROM e GROUP BY 1, 2),
    states AS (
        SELECT run_id, target_id, min(status) FILTER (sec * 100000000 + seq = coalesce(c, l)) AS status,
               count(*) FILTER (status = 'REPAIR_REQUESTED' AND (c IS NULL OR sec * 100000000 + seq < c)) AS repair_rounds
        FROM e JOIN cut USING (run_id, target_id) GROUP BY 1, 2
    )"""
add("t01_current_states", lambda t: T.current_states(t("target_events")), f"WITH {_STATES} SELECT * FROM states")
add(
    "a06_manifest_totals", lambda t: T.manifest_totals(T.current_states(t("target_events"))),
    f"""WITH {_STATES}, b AS (SELECT run_id, CASE WHEN status IN ('GENERATED', 'APPLIED', 'REPAIR_REQUESTED', 'REPAIRED') THEN 'generated' WHEN status = 'SKIPPED' THEN 'skipped' WHEN status = 'PASSED' THEN 'passed'
        WHEN status = 'ABANDONED' THEN 'abandoned' WHEN status IN ('GENERATION_FAILED', 'PATCH_FAILED', 'COMPILE_FAILED', 'TEST_FAILED') THEN 'failed' ELSE 'pending' END AS b FROM states)
        SELECT run_id, {", ".join(f"count(*) FILTER (b = '{n}') AS {n}" for n in T.BUCKET_NAMES)} FROM b GROUP BY run_id""",
)
add(
    "a13_repair_stats",
    lambda t: T.repair_stats(t("interactions").select("run_id", F.when(F.col("role") == "repair", "llm").when(F.col("role") == "review", "rule").alias("by"), F.col("tokens_in").alias("tokens"))),
    """WITH c AS (SELECT run_id, count(*) FILTER (role = 'review') AS r, count(*) FILTER (role = 'repair') AS l, CAST(coalesce(SUM(tokens_in), 0) AS BIGINT) AS tokens FROM interactions GROUP BY 1)
       SELECT run_id, r AS rule_hits, l AS llm_hits, tokens, CASE WHEN r + l = 0 THEN 0.0::DOUBLE ELSE round_even(CAST(r AS DOUBLE) / CAST(r + l AS DOUBLE), 6) END AS rule_rate FROM c""",
)
add(
    "a14_cycle_outcomes",
    lambda t: T.cycle_outcomes(
        t("test_cases").select(
            (F.col("pos") % 40).alias("cycle"), "sut", F.concat(F.lit("ev"), (F.col("pos") % 300).cast("string")).alias("evidence_id"),
            F.when(F.col("status") == "FAIL", F.concat(F.lit("G"), F.col("errors").cast("string"))).alias("discard_reason"),
        )
    ),
    """WITH x AS (SELECT pos % 40 AS cycle, sut, 'ev' || CAST(pos % 300 AS STRING) AS ev, CASE WHEN status = 'FAIL' THEN 'G' || CAST(errors AS STRING) END AS r FROM test_cases),
       h AS (SELECT cycle, string_agg(r || '=' || CAST(n AS STRING), ',' ORDER BY r) AS reasons FROM (SELECT cycle, r, count(*) AS n FROM x WHERE r IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
       SELECT cycle, count(*) FILTER (r IS NULL) AS generated, count(*) FILTER (r IS NOT NULL) AS discarded, string_agg(DISTINCT sut, ',' ORDER BY sut) AS suts,
              array_to_string(list_slice(list_sort(list_distinct(list(ev))), 1, 50), ',') AS evidence_ids, coalesce(any_value(reasons), '') AS reasons
       FROM x LEFT JOIN h USING (cycle) GROUP BY cycle""",
)
add(
    "a15_majority", lambda t: T.majority(t("classes").withColumn("annotation", F.coalesce("annotation", F.lit("unknown"))), "annotation", ["repo"]),
    """WITH c AS (SELECT repo, annotation AS v, count(*) AS n FROM classes WHERE annotation IS NOT NULL GROUP BY 1, 2)
       SELECT repo, arg_min(v, -n * 1000 + k) AS majority_annotation FROM (SELECT *, row_number() OVER (ORDER BY v) AS k FROM c) GROUP BY repo""",
)
_PACKS = "packs AS (SELECT repo, path, size AS bytes, CAST(floor(size * 0.25) AS BIGINT) AS tokens, floor(size * 0.25) > 4000 AS over_budget FROM source_files)"


def _packs(t):
    return T.token_budget(t("source_files").select("repo", "path", F.col("size").alias("bytes")))


add("a16_token_budget", _packs, f"WITH {_PACKS} SELECT * FROM packs")
add(
    "a16_token_budget_totals", lambda t: T.token_budget_totals(_packs(t), "repo"),
    f"WITH {_PACKS} SELECT repo, count(*) AS packs, CAST(SUM(tokens) AS BIGINT) AS tokens, count(*) FILTER (over_budget) AS over, max(tokens) AS largest FROM packs GROUP BY repo",
)
_SIZES = "sizes AS (SELECT repo, count(*) AS files, CAST(SUM(size) AS BIGINT) AS bytes FROM source_files WHERE NOT (path LIKE 'target/%' OR path LIKE '.git/%') GROUP BY repo)"
add("a18_workspace_size", lambda t: T.workspace_size(t("source_files")), f"WITH {_SIZES} SELECT * FROM sizes")


def _ledger(t):
    costed = _costed(t).withColumn("repo", F.concat(F.lit("repo-src"), (F.substring("run_id", 4, 9).cast("long") % 20).cast("string")))
    return costed.groupBy("repo").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"),
        (F.sum(F.bround(F.col("cost_usd") * 1e6, 0).cast("long")) / 1e6).alias("cost_usd"), F.bool_or("estimated").alias("estimated"), F.sum("tokens_in").alias("sent_bytes"),
    )


add(
    "a17_cost_efficiency", lambda t: T.cost_efficiency(T.workspace_size(t("source_files")), _ledger(t)),
    f"""WITH {_COSTED}, {_SIZES}, led AS (SELECT 'repo-src' || CAST(CAST(substr(run_id, 4) AS BIGINT) % 20 AS STRING) AS repo, count(*) AS calls, CAST(SUM(tokens_in + tokens_out) AS BIGINT) AS tokens,
            CAST(SUM(CAST(round_even(cost_usd * 1e6, 0) AS BIGINT)) AS BIGINT) / 1e6 AS usd, bool_or(estimated) AS est, CAST(SUM(tokens_in) AS BIGINT) AS sent FROM costed GROUP BY 1),
        b AS (SELECT *, CAST(ceil(bytes / 4) * calls AS BIGINT) AS base FROM sizes JOIN led USING (repo)),
        s AS (SELECT *, greatest(0, base - tokens) AS saved FROM b)
        SELECT repo, base AS baseline_tokens, tokens AS actual_tokens, CAST(saved AS BIGINT) AS saved_tokens, round_even(CAST(base AS DOUBLE) / CAST(tokens AS DOUBLE), 4) AS factor,
               round_even(saved * 100.0::DOUBLE / CAST(base AS DOUBLE), 2) AS savings_pct, round_even(CAST(bytes * calls AS DOUBLE) / CAST(sent AS DOUBLE), 4) AS byte_factor, round_even(saved * (usd / CAST(tokens AS DOUBLE)), 6) AS saved_usd,
               CASE WHEN est THEN 'size_estimate' ELSE 'api_usage' END AS source FROM s""",
)
add(
    "a24_batch_decision",
    lambda t: T.batch_decision(
        t("responses").select(
            "batch_id", F.when(F.col("status") == "generated", "passed").when(F.col("status") == "NEED_MORE_CONTEXT", "needs_context").otherwise("failed").alias("status"),
            (F.col("pos") % 997 == 0).alias("global_error"),
        )
    ),
    """WITH o AS (SELECT batch_id, count(*) FILTER (status = 'generated') AS passed, count(*) FILTER (status <> 'NEED_MORE_CONTEXT') AS effective, bool_or(pos % 997 = 0) AS global_error FROM responses GROUP BY 1),
       r AS (SELECT *, CASE WHEN effective = 0 THEN 1.0::DOUBLE ELSE CAST(passed AS DOUBLE) / CAST(effective AS DOUBLE) END AS x FROM o)
       SELECT batch_id, passed, effective, global_error, round_even(x, 6) AS rate, CASE WHEN global_error THEN 'REPAIR_THEN_CONTINUE' WHEN passed = effective THEN 'CONTINUE' WHEN x >= 0.5 THEN 'REPAIR_THEN_CONTINUE' ELSE 'STOP' END AS decision,
              CASE WHEN global_error THEN 'GLOBAL_COMPILE_ERROR' WHEN effective = 0 THEN 'ALL_NEED_MORE_CONTEXT' WHEN passed = effective THEN 'ALL_PASSED' WHEN x >= 0.8 THEN 'REPAIR_FAILURES'
                   WHEN x >= 0.5 THEN 'REPAIR_FIRST' ELSE 'TOO_MANY_FAILURES' END AS reason FROM r""",
)
add(
    "a29_pack_self_assessment", lambda t: T.pack_self_assessment(t("part").select(F.when(F.col("p_size") % 7 > 0, F.concat(F.lit(" size"), F.col("p_size") % 7)).otherwise(" ").alias("s")), "s"),
    "SELECT CASE WHEN p_size % 7 > 0 THEN 'SIZE' || CAST(p_size % 7 AS STRING) ELSE 'UNKNOWN' END AS bucket, count(*) AS n FROM part GROUP BY 1",
)
_STALL = """
    m AS (SELECT *, lines_delta IS NOT NULL AND branches_delta IS NOT NULL AS me, coalesce(lines_delta = 0 AND branches_delta = 0, FALSE) AS fl FROM cycle_events),
    i AS (SELECT *, SUM(CASE WHEN me AND NOT fl THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY cycle) AS isl FROM m),
    stall AS (SELECT run_id, cycle, lines_delta, branches_delta, compile_failed,
        CAST(SUM(CASE WHEN fl AND me THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, isl ORDER BY cycle) AS BIGINT) AS stall_streak FROM i),
    stalls AS (SELECT *, stall_streak >= 2 AS stalled FROM stall)"""
add("w07_stall_streak", lambda t: T.stall_streak(t("cycle_events")), f"WITH {_STALL} SELECT * FROM stalls")
add(
    "w08_compile_fail_window", lambda t: T.compile_fail_window(t("cycle_events")),
    f"""WITH {_STALL}, f AS (SELECT *, avg(CASE WHEN compile_failed THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY run_id ORDER BY cycle ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS fail_rate FROM stalls)
        SELECT *, CASE WHEN stalled THEN 'G8_STALL' WHEN fail_rate > 0.5 THEN 'G8_COMPILE_FAIL_RATE' ELSE 'PASS' END AS gate FROM f""",
)
add(
    "w12_dynamic_batch_size",
    lambda t: T.dynamic_batch_size(
        t("cycle_events").select(
            "run_id", "cycle", F.when(F.col("compile_failed"), 0.5).otherwise(0.0).alias("fail_rate"),
            (F.coalesce("lines_delta", F.lit(0)) + F.coalesce("branches_delta", F.lit(0))).alias("delta"), (F.col("cycle") % 5 == 0).alias("slow"),
        )
    ),
    """WITH c AS (SELECT run_id, cycle, CASE WHEN compile_failed THEN 0.5::DOUBLE ELSE 0 END AS fail_rate, coalesce(lines_delta, 0) + coalesce(branches_delta, 0) AS delta, cycle % 5 = 0 AS slow,
            row_number() OVER (PARTITION BY run_id ORDER BY cycle) AS n FROM cycle_events),
       j AS (SELECT c.*, p.fail_rate AS r1, p.delta AS d1, q.fail_rate AS r2, q.delta AS d2 FROM c LEFT JOIN c p ON p.run_id = c.run_id AND p.n = c.n - 1 LEFT JOIN c q ON q.run_id = c.run_id AND q.n = c.n - 2),
       s AS (SELECT *, CASE WHEN r1 > 0.3 THEN 2 WHEN r1 = 0 AND r2 = 0 AND d1 > 0 AND d2 > 0 THEN 7 ELSE 5 END AS size FROM j)
       SELECT run_id, cycle, fail_rate, delta, slow, CAST(CASE WHEN slow AND size > 3 THEN 3 ELSE size END AS INTEGER) AS batch_size FROM s""",
)
add(
    "w15_retain_cycles", lambda t: T.retain_cycles(t("cycle_events"), t("cycle_events").filter("cycle % 2 = 0"), 2),
    """WITH s AS (SELECT run_id, cycle, dense_rank() OVER (PARTITION BY run_id ORDER BY cycle DESC) AS r FROM cycle_events WHERE cycle % 2 = 0),
       cut AS (SELECT run_id, cycle AS c FROM s WHERE r = 3)
       SELECT e.* FROM cycle_events e LEFT JOIN cut USING (run_id) WHERE c IS NULL OR e.cycle > c""",
)
_ACTIVE = """
    b AS (SELECT *, last_value(CASE WHEN kind IN ('pause', 'resume') THEN kind END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY sec, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef FROM clock_events),
    o AS (SELECT *, last_value(CASE WHEN kind = 'pause' AND coalesce(bef, 'resume') <> 'pause' THEN sec END IGNORE NULLS) OVER w AS opened,
              last_value(CASE WHEN kind IN ('pause', 'resume') THEN kind END IGNORE NULLS) OVER w AS now, first_value(sec) OVER w AS start FROM b
          WINDOW w AS (PARTITION BY run_id ORDER BY sec, seq ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT run_id, seq, sec, kind, CAST(sec - start - coalesce(SUM(CASE WHEN kind = 'resume' AND bef = 'pause' THEN sec - opened END) OVER w, 0)
              - CASE WHEN now = 'pause' THEN sec - opened ELSE 0 END AS BIGINT) AS active_seconds, CAST(SUM(CASE WHEN kind = 'cycle' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS cycles FROM o
          WINDOW w AS (PARTITION BY run_id ORDER BY sec, seq ROWS UNBOUNDED PRECEDING))"""
add("w17_elapsed_active", lambda t: T.elapsed_active(t("clock_events")), f"WITH {_ACTIVE} SELECT *, active_seconds > 600 OR cycles > 20 AS over_budget FROM a")

add(
    "p10_tokens",
    lambda t: t("documents").select("doc_id", S.estimate_tokens(F.col("text")).alias("estimated"), S.tokens_from_bytes(F.col("n_chars")).alias("from_bytes"), S.pack_tokens(F.col("n_chars")).alias("pack")),
    """SELECT doc_id, CAST(greatest(1, ceil(length(coalesce(text, '')) / 4)) AS BIGINT) AS estimated, CAST(CASE WHEN n_chars > 0 THEN ceil(n_chars / 4) ELSE 0 END AS BIGINT) AS from_bytes,
              CAST(floor(n_chars * 0.25) AS BIGINT) AS pack FROM documents""",
)
add(
    "p13_extract_usage",
    lambda t: t("events").select("event_id", S.extract_usage(F.concat(F.lit('{"usage":{"input_tokens":'), F.get_json_object("props", "$.k"), F.lit(',"x":1}}'))).alias("u")).select("event_id", "u.tokens_in", "u.tokens_out"),
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_in, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN NULL ELSE CAST(0 AS BIGINT) END AS tokens_out FROM events",
)
add(
    "p23_efficiency_units",
    lambda t: t("source_files").select("doc_id", S.human_size(F.col("size") * 997).alias("human"), F.bround(S.reduction_factor(F.col("size") * 1000, F.col("size") % 17), 4).alias("factor")),
    """SELECT doc_id, CASE WHEN size * 997 >= 1048576 THEN printf('%.2f MB', size * 997 / 1048576) ELSE printf('%.2f KB', size * 997 / 1024) END AS human,
              CASE WHEN size % 17 = 0 THEN NULL ELSE round_even(CAST(size * 1000 AS DOUBLE) / CAST(size % 17 AS DOUBLE), 4) END AS factor FROM source_files""",
)
