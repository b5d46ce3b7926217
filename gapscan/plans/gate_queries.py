"""Gates, reconciliation and repair."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import gates as G
from .catalog import CATALOG

add = CATALOG.add

add(
    "j03_gate_imports", lambda t: G.gate_imports(t("imports").select("patch_id", "import"), t("whitelist")),
    """WITH m AS (SELECT patch_id, string_agg(DISTINCT import, ',' ORDER BY import) AS missing FROM imports WHERE import NOT IN (SELECT name FROM whitelist) GROUP BY 1)
       SELECT DISTINCT i.patch_id, CASE WHEN m.missing IS NULL THEN 'PASS' ELSE 'FAIL' END AS verdict, coalesce(m.missing, '') AS missing FROM imports i LEFT JOIN m USING (patch_id)""",
)
add(
    "j04_lint_imports", lambda t: G.lint_imports(t("imports").withColumn("is_static", (F.col("pos") % 3 == 0) & ~F.col("import").endswith("*")), t("whitelist")),
    """WITH n AS (SELECT *, pos % 3 = 0 AND NOT import LIKE '%*' AS is_static, import LIKE '%.*' AS wild, regexp_replace(import, '\\.\\*$', '') AS bare FROM imports),
       m AS (SELECT *, CASE WHEN is_static THEN regexp_extract(bare, '^(.*)\\.[^.]*$', 1) ELSE bare END AS name FROM n),
       p AS (SELECT *, CASE WHEN wild THEN name ELSE regexp_extract(name, '^(.*)\\.[^.]*$', 1) END AS pkg FROM m)
       SELECT patch_id, pos, import, is_static, CASE WHEN is_static AND (starts_with(import, 'org.mockito.') OR starts_with(import, 'org.junit.Assert')) THEN 'OK_SAFE_OWNER'
              WHEN NOT wild AND name IN (SELECT name FROM whitelist WHERE level = 'class') THEN 'OK_CLASS' WHEN NOT is_static AND (starts_with(import, 'java.') OR starts_with(import, 'javax.')) THEN 'OK_JDK'
              WHEN pkg IN (SELECT name FROM whitelist WHERE level = 'package') THEN 'OK_PACKAGE' WHEN is_static THEN 'STATIC_IMPORT_NOT_WHITELISTED'
              WHEN wild THEN 'IMPORT_PKG_NOT_WHITELISTED' ELSE 'IMPORT_NOT_WHITELISTED' END AS kind FROM p""",
)


def _patch_methods(t):
    m = t("members")
    ids = F.when(F.col("pos") == 2, F.array().cast("array<string>")).when(F.col("n_params") == 4, F.array("evidence_id", F.lit("ev:none"))).when(
        F.col("n_params") == 3, F.array(F.lit("inherited:getCause"))).otherwise(F.array("evidence_id"))
    status = F.when(F.length("fqcn") % 7 == 0, "BLOCKED").otherwise("OK")
    return m.select(F.concat(F.lit("patch:"), "fqcn", F.lit(":"), (F.col("pos") % 2).cast("string")).alias("patch_id"), status.alias("status"), F.col("name").alias("method"), ids.alias("evidence_ids"))


add(
    "j05_gate_evidence", lambda t: G.gate_evidence(_patch_methods(t), t("members").filter("usable")),
    """WITH pm AS (SELECT 'patch:' || fqcn || ':' || CAST(pos % 2 AS STRING) AS patch_id, length(fqcn) % 7 = 0 AS b, name,
           CASE WHEN pos = 2 THEN [] WHEN n_params = 4 THEN [evidence_id, 'ev:none'] WHEN n_params = 3 THEN ['inherited:getCause'] ELSE [evidence_id] END AS ids FROM members),
       o AS (SELECT patch_id, string_agg(DISTINCT id, ',' ORDER BY id) AS orphan_ids FROM (SELECT patch_id, unnest(ids) AS id FROM pm WHERE NOT b)
             WHERE id <> 'inherited:getCause' AND id NOT IN (SELECT evidence_id FROM members WHERE usable) GROUP BY 1),
       p AS (SELECT patch_id, bool_and(b) AS blocked, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (len(ids) = 0 AND NOT b), '') AS no_evidence FROM pm GROUP BY 1)
       SELECT patch_id, CASE WHEN blocked THEN 'SKIPPED' WHEN no_evidence <> '' OR orphan_ids IS NOT NULL THEN 'FAIL' ELSE 'PASS' END AS verdict, no_evidence, coalesce(orphan_ids, '') AS orphan_ids
       FROM p LEFT JOIN o USING (patch_id)""",
)
_ATTEMPTS = """SELECT event_id AS attempt_id, CASE WHEN event_id % 5 = 0 THEN 'generate' ELSE 'repair' END AS mode, error_code,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE symbol_fqn END AS symbol_fqn, fix_id, test_case_id FROM failure_memory WHERE event_id % 2 = 0"""


def _attempts(t):
    m = t("failure_memory").filter("event_id % 2 = 0")
    return m.selectExpr(
        "event_id AS attempt_id", "CASE WHEN event_id % 5 = 0 THEN 'generate' ELSE 'repair' END AS mode", "error_code",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE symbol_fqn END AS symbol_fqn", "fix_id", "test_case_id",
    )


add(
    "j06_gate_failure_memory", lambda t: G.gate_failure_memory(_attempts(t), t("failure_memory")),
    f"""WITH a AS ({_ATTEMPTS}), h AS (SELECT error_code AS c, symbol_fqn AS s, fix_id AS f, SUM(attempts) AS n, bool_or(last_result = 'FAILED') AS bad FROM failure_memory GROUP BY 1, 2, 3),
        k AS (SELECT test_case_id, SUM(attempts) AS n FROM failure_memory GROUP BY 1)
        SELECT attempt_id, sha256(error_code || chr(0) || coalesce(symbol_fqn, '') || chr(0) || fix_id) AS hash,
               CASE WHEN mode <> 'repair' THEN 'SKIPPED' WHEN symbol_fqn IS NULL THEN 'FAIL_NO_TRIPLET' WHEN coalesce(bad, FALSE) AND h.n >= 2 THEN 'FAIL_HASH'
                    WHEN coalesce(k.n, 0) > 3 THEN 'FAIL_CASE' ELSE 'PASS' END AS verdict
        FROM a LEFT JOIN h ON a.error_code = c AND a.symbol_fqn = s AND a.fix_id = f LEFT JOIN k USING (test_case_id)""",
)
add(
    "j07_gate_stack",
    lambda t: G.gate_stack(
        t("part").select(
            F.col("p_partkey").alias("pack_id"), (F.col("p_size") % 10 == 0).alias("blocked"),
            F.create_map(F.lit("javaVersion"), F.lit("unknown"), F.lit("test"), F.when(F.col("p_size") % 3 == 0, "Unknown").otherwise("junit5"), F.lit("mock"), F.when(F.col("p_size") % 4 == 0, "unknown").otherwise("mockito")).alias("stack"),
        )
    ),
    """WITH u AS (SELECT p_partkey, p_size, concat_ws(',', CASE WHEN p_size % 4 = 0 THEN 'mock' END, CASE WHEN p_size % 3 = 0 THEN 'test' END) AS unknown FROM part)
       SELECT p_partkey AS pack_id, CASE WHEN p_size % 10 = 0 OR unknown <> '' THEN 'FAIL' ELSE 'PASS' END AS verdict, unknown FROM u""",
)
add(
    "j07_gate_positional_stack",
    lambda t: G.gate_stack(
        t("part").selectExpr("p_partkey AS pack_id", "CASE WHEN p_size % 10 = 0 THEN TRUE END AS blocked", "CAST(NULL AS MAP<STRING, STRING>) AS stack",
                             "transform(sequence(0, 9), i -> CASE WHEN p_size % 3 = 0 AND i = p_partkey % 10 THEN 'UNKNOWN' WHEN i <> 4 THEN 'x' END) AS positional")
    ),
    """WITH u AS (SELECT p_partkey AS pack_id, p_size % 10 = 0 AS blocked, CASE WHEN p_size % 3 = 0 AND p_partkey % 10 NOT IN (0, 6, 7, 8) THEN CAST(p_partkey % 10 AS STRING) ELSE '' END AS unknown FROM part)
       SELECT pack_id, CASE WHEN blocked OR unknown <> '' THEN 'FAIL' ELSE 'PASS' END AS verdict, unknown FROM u""",
)
add(
    "f08_preflight_gate",
    lambda t: G.preflight_gate(
        t("classes").selectExpr(
            "fqcn AS target_id", "kind", "CASE WHEN class_no % 6 = 0 THEN '<clinit>' WHEN class_no % 6 = 1 THEN '<init>' WHEN class_no % 6 = 2 THEN 'values' ELSE 'run' END AS method_name",
            "CASE WHEN class_no % 13 = 0 THEN array() ELSE array('a', 'b') END AS evidence_ids", "CASE WHEN class_no % 17 = 0 THEN array('z') ELSE array() END AS required_ids",
            "CASE WHEN class_no % 4 = 0 THEN array('X') ELSE array() END AS enum_constants", "CASE WHEN class_no % 3 = 0 THEN array('<init>', 'valueOf') ELSE array('go') END AS member_names",
            "CASE WHEN class_no % 8 = 3 THEN 'void other() {}' WHEN class_no % 8 = 5 THEN 'void run () {}' END AS body",
        )
    ).select("target_id", "skip_reason"),
    """WITH c AS (SELECT fqcn AS target_id, kind, class_no AS n, CASE WHEN class_no % 6 = 0 THEN '<clinit>' WHEN class_no % 6 = 1 THEN '<init>' WHEN class_no % 6 = 2 THEN 'values' ELSE 'run' END AS m FROM classes)
       SELECT target_id, CASE WHEN n % 13 = 0 OR n % 17 = 0 THEN 'MISSING_TYPE_EVIDENCE' WHEN (m = '<clinit>' OR (kind = 'enum' AND m = 'values')) AND n % 4 <> 0 THEN 'CLINIT_WITHOUT_ENUM_CONSTANTS'
              WHEN kind = 'enum' AND m = '<init>' AND n % 3 = 0 THEN 'MISSING_TYPE_EVIDENCE'
              WHEN (n % 8 = 3 AND NOT starts_with(m, '<')) OR (n % 8 = 5 AND m NOT IN ('<clinit>', '<init>', 'run')) THEN 'TARGET_METHOD_BODY_MISSING' END AS skip_reason FROM c""",
)
_RECONCILED = """
    ans AS (SELECT *, row_number() OVER (PARTITION BY batch_id, target_id ORDER BY pos) AS nth, upper(status) AS st FROM responses),
    rec AS (SELECT coalesce(q.batch_id, a.batch_id) AS batch_id, coalesce(q.target_id, a.target_id) AS target_id, CAST(coalesce(nth, 0) AS INTEGER) AS nth,
        CASE WHEN q.target_id IS NULL THEN 'unknown' WHEN nth IS NULL THEN 'omitted' WHEN nth > 1 THEN 'duplicated' WHEN st = 'NEED_MORE_CONTEXT' THEN 'need-more-context' WHEN st = 'SKIPPED' THEN 'skipped'
             WHEN st = 'FAILED' THEN 'failed' WHEN st <> 'GENERATED' THEN 'invalid-status' WHEN n_methods = 0 THEN 'invalid-no-methods' ELSE 'valid' END AS outcome
        FROM requests q FULL JOIN ans a ON q.batch_id = a.batch_id AND q.target_id = a.target_id)"""


def _reconciled(t):
    return G.reconcile(t("requests"), t("responses"))


add("j09_reconcile", _reconciled, f"WITH {_RECONCILED} SELECT * FROM rec")
add(
    "a25_validation_counts", lambda t: G.validation_counts(_reconciled(t), t("test_cases").withColumn("batch_id", F.concat(F.lit("b"), (F.col("pos") % 150).cast("string")))),
    f"""WITH {_RECONCILED}, w AS (SELECT batch_id, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o.replace('-', '_')}" for o in G.OUTCOMES)} FROM rec GROUP BY 1),
        r AS (SELECT 'b' || CAST(pos % 150 AS STRING) AS batch_id, count(*) FILTER (status = 'PASS') AS p, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'SKIP') AS s, count(*) AS n FROM test_cases GROUP BY 1)
        SELECT w.*, coalesce(p, 0) AS tests_pass, coalesce(f, 0) AS tests_fail, coalesce(s, 0) AS tests_skip, coalesce(n, 0) AS tests FROM w LEFT JOIN r USING (batch_id)""",
)
add(
    "j10_validate_patch_methods",
    lambda t: G.validate_patch_methods(
        t("classes").selectExpr(
            "class_no", "CASE WHEN class_no % 23 = 0 THEN NULL WHEN class_no % 23 = 1 THEN 2 ELSE 1 END AS schema_version", "CASE WHEN class_no % 19 = 0 THEN 'p:1' ELSE 'patch:1' END AS patch_id",
            "fqcn AS sut", "CASE WHEN class_no % 17 = 0 THEN 'x' ELSE fqcn END AS request_sut", "concat(fqcn, CASE WHEN class_no % 13 = 0 THEN 'IT' ELSE 'Test' END) AS test_class",
            "CASE WHEN class_no % 11 = 0 THEN array('a.B', 'c.D') ELSE array('a.B') END AS imports", "array('a.B') AS allowed_imports", "CASE WHEN class_no % 7 = 0 THEN array('E') ELSE array('B') END AS annotations",
            "CASE WHEN class_no % 10 = 0 THEN array() WHEN class_no % 10 = 1 THEN array('e9') ELSE array('e1') END AS evidence_ids", "array('e1', 'e2') AS allowed_ids",
            "CASE WHEN class_no % 9 = 0 THEN array('e2') ELSE array() END AS required_ids", "concat(substring_index(fqcn, '.', -1), ' sut = make(); sut', CASE WHEN class_no % 5 = 0 THEN '.leap();' ELSE '.run(\"sut.leap()\"); other.leap();' END) AS body",
            "array('run') AS evidenced_methods",
        )
    ).select("class_no", "reason"),
    """SELECT class_no, CASE WHEN class_no % 23 = 0 THEN 'MISSING_KEY' WHEN class_no % 23 = 1 THEN 'BAD_VERSION' WHEN class_no % 19 = 0 THEN 'BAD_PATCH_ID' WHEN class_no % 17 = 0 THEN 'CLASS_MISMATCH'
              WHEN class_no % 13 = 0 THEN 'TEST_CLASS_MISMATCH' WHEN class_no % 11 = 0 THEN 'IMPORT_NOT_ALLOWED' WHEN class_no % 7 = 0 THEN 'ANNOTATION_WITHOUT_IMPORT' WHEN class_no % 10 = 0 THEN 'NO_EVIDENCE'
              WHEN class_no % 10 = 1 THEN 'EVIDENCE_NOT_ALLOWED' WHEN class_no % 9 = 0 THEN 'TARGET_EVIDENCE_MISSING' WHEN class_no % 5 = 0 THEN 'CALL_WITHOUT_EVIDENCE' END AS reason FROM classes""",
)
add(
    "j14_failures_to_errors",
    lambda t: G.failures_to_errors(
        t("classes").filter("class_no % 5 = 0").selectExpr("repo AS run_id", "concat(fqcn, 'Test') AS test_class", "fqcn AS sut"),
        t("classes").filter("class_no % 3 = 0").selectExpr("repo AS run_id", "concat('C:/w/src/test/java/', replace(fqcn, '.', '/'), 'Test.java') AS file", "concat('E', class_no % 3, class_no % 4) AS code", "annotation AS symbol"),
        t("region").selectExpr("concat('E0', r_regionkey) AS code", "concat('FIX_', r_regionkey) AS fix_id").filter("code <> 'E03'"),
    ),
    """SELECT DISTINCT f.repo AS run_id, f.fqcn || 'Test' AS test_class, CASE WHEN e.fqcn IS NULL THEN 'E_TEST_FAILURE' ELSE 'E0' || CAST(e.class_no % 4 AS STRING) END AS error_code,
              coalesce(e.annotation, f.fqcn) AS symbol, CASE WHEN e.fqcn IS NOT NULL AND e.class_no % 4 <> 3 THEN 'FIX_' || CAST(e.class_no % 4 AS STRING) ELSE 'FIX_REPAIR' END AS fix_id
       FROM (SELECT * FROM classes WHERE class_no % 5 = 0) f LEFT JOIN (SELECT * FROM classes WHERE class_no % 3 = 0) e ON f.repo = e.repo AND f.fqcn = e.fqcn""",
)
add(
    "j15_dispatch_rules",
    lambda t: G.dispatch_rules(
        t("part").selectExpr("p_partkey AS violation_id", "concat('K', p_size % 7) AS kind", "map('file', 'f', 'line', CASE WHEN p_size % 2 = 0 THEN 'x' END) AS fields"),
        t("nation").selectExpr("n_nationkey AS rule_order", "concat('K', n_nationkey % 6) AS kind", "CASE n_nationkey % 6 WHEN 1 THEN 'escalate' ELSE 'swap' END AS action",
                               "CASE n_nationkey % 6 WHEN 2 THEN concat('use $', '{line} in $', '{file}') WHEN 3 THEN concat('$', '{file}') ELSE '' END AS args", "n_nationkey % 6 <> 4 AS known_action"),
    ),
    """WITH v AS (SELECT p_partkey AS violation_id, p_size % 7 AS k, p_size % 2 = 0 AS has_line FROM part)
       SELECT violation_id, 'K' || CAST(k AS STRING) AS kind, CASE WHEN k < 6 THEN CAST(k AS INTEGER) END AS rule_order,
              CASE WHEN k IN (1, 6) THEN 'ESCALATED' WHEN k = 4 THEN 'UNKNOWN_ACTION' WHEN k = 2 AND NOT has_line THEN 'UNRESOLVED' ELSE 'ACTIONABLE' END AS decision,
              CASE WHEN k = 6 THEN NULL WHEN k = 2 AND NOT has_line THEN 'line' ELSE '' END AS unresolved FROM v""",
)
add(
    "j22_missing_framework_imports",
    lambda t: G.missing_framework_imports(
        t("classes").selectExpr("fqcn AS file", "CASE class_no % 4 WHEN 0 THEN 'void a() { assertThat(x); when(y); }' WHEN 1 THEN 'ArgumentCaptor<A> c; Mockito.when(a); z.fail();' WHEN 2 THEN '// verify(x)' ELSE 'x = \"eq(1)\"; Assertions.assertEquals(1, anyInt());' END AS body"),
        t("classes").selectExpr("fqcn AS file", "CASE class_no % 5 WHEN 0 THEN 'org.hamcrest.MatcherAssert.assertThat' WHEN 1 THEN 'org.mockito.*' WHEN 2 THEN 'org.junit.jupiter.api.Assertions.*' WHEN 3 THEN 'my.Mockito' ELSE 'a.B' END AS import", "class_no % 5 IN (0, 2) AS is_static"),
    ),
    """WITH s AS (SELECT * FROM (VALUES (0, 'static', 'assertThat'), (0, 'static', 'when'), (1, 'type', 'ArgumentCaptor'), (1, 'type', 'Mockito'), (3, 'type', 'Assertions'), (3, 'static', 'anyInt')) AS x(k, kind, symbol))
       SELECT fqcn AS file, s.kind, symbol FROM classes JOIN s ON class_no % 4 = k
       WHERE NOT (class_no % 5 = 0 AND symbol = 'assertThat') AND NOT (class_no % 5 = 1 AND s.kind = 'type') AND NOT (class_no % 5 = 2 AND s.kind = 'static') AND NOT (class_no % 5 = 3 AND symbol = 'Mockito')""",
)
add(
    "w04_failure_digest", lambda t: G.failure_digest(t("failure_memory"), t("targets").select("sut")),
    """WITH f AS (SELECT *, split_part(symbol_fqn, '#', 1) AS sut FROM failure_memory WHERE last_result = 'FAILED' AND split_part(symbol_fqn, '#', 1) IN (SELECT sut FROM targets)),
       n AS (SELECT *, row_number() OVER (PARTITION BY sut, error_code, fix_id ORDER BY last_seen_cycle DESC, event_id DESC) > 1 AS again FROM f),
       p AS (SELECT * EXCLUDE (again), CAST(row_number() OVER (PARTITION BY sut ORDER BY again, last_seen_cycle DESC, event_id DESC) AS INTEGER) AS place FROM n)
       SELECT * FROM p WHERE place <= 8""",
)
_FAILURES = (
    "concat('t', user_id) AS target_id", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS round",
    "CASE event_type WHEN 'error' THEN 'COMPILATION_ERROR' WHEN 'click' THEN 'PATCH_REJECTED' ELSE 'TEST_FAILURE' END AS kind", "CASE WHEN event_id % 3 = 0 THEN 'COMPILATION_ERROR' ELSE 'odd' END AS summary",
    "CASE WHEN event_id % 4 = 0 THEN concat('a\\nb', event_id % 8) END AS compiler", "CASE WHEN event_id % 5 = 0 THEN '[BLOCKED] G6\\nx' END AS patcher", "CASE WHEN event_id % 7 = 0 THEN 'log' END AS build",
)
add(
    "w13_repair_admission", lambda t: G.repair_admission(t("events").selectExpr(*_FAILURES)).select("target_id", "round", "signature", "abandon_reason"),
    """WITH f AS (SELECT 't' || CAST(user_id AS STRING) AS target_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS round,
           CASE event_type WHEN 'error' THEN 'COMPILATION_ERROR' WHEN 'click' THEN 'PATCH_REJECTED' ELSE 'TEST_FAILURE' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'COMPILATION_ERROR' ELSE 'odd' END AS summary,
           CASE WHEN event_id % 4 = 0 THEN 'a' || chr(10) || 'b' || CAST(event_id % 8 AS STRING) ELSE '' END AS c, CASE WHEN event_id % 5 = 0 THEN '[BLOCKED] G6' ELSE '' END AS p, event_id % 7 = 0 AS build FROM events),
       s AS (SELECT *, left(sha1(kind || '||' || summary || '||' || c || '||' || p), 16) AS signature FROM f),
       l AS (SELECT *, lag(signature) OVER (PARTITION BY target_id ORDER BY round) AS b, c = '' AND p = '' AND NOT build AS bare FROM s)
       SELECT target_id, round, signature, CASE WHEN round >= 3 THEN 'NO_PROGRESS_AFTER_REPAIR' WHEN signature = b THEN 'REPEATED_FAILURE_SIGNATURE'
              WHEN kind = 'PATCH_REJECTED' AND c = '' AND p = '' THEN 'PATCHER_REJECTED_WITHOUT_DIAGNOSTICS' WHEN kind <> 'TEST_FAILURE' AND bare AND summary = 'COMPILATION_ERROR' THEN 'NO_ACTIONABLE_LOGS'
              WHEN bare AND round > 1 THEN 'NO_PROGRESS_AFTER_REPAIR' END AS abandon_reason FROM l""",
)
add(
    "c04_missing_symbols",
    lambda t: G.missing_symbols(
        t("events").selectExpr(
            "concat('run', user_id % 90) AS run_id", "row_number() OVER (PARTITION BY user_id % 90 ORDER BY event_id) AS line_no",
            "CASE event_type WHEN 'error' THEN 'F.java:1: error: cannot find symbol' WHEN 'click' THEN concat('  symbol:   variable v', event_id % 5) WHEN 'view' THEN concat('  location: class C', event_id % 3, '  ') ELSE 'noise' END AS line",
        )
    ),
    """WITH l AS (SELECT 'run' || CAST(user_id % 90 AS STRING) AS run_id, row_number() OVER (PARTITION BY user_id % 90 ORDER BY event_id) AS line_no, event_type AS y, event_id FROM events),
       m AS (SELECT *, SUM(CASE WHEN y = 'error' THEN 1 ELSE 0 END) OVER w AS blk, last_value(CASE WHEN y = 'error' THEN line_no END IGNORE NULLS) OVER w AS st FROM l WINDOW w AS (PARTITION BY run_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
       i AS (SELECT * FROM m WHERE blk > 0 AND line_no > st AND line_no <= st + 6),
       f AS (SELECT run_id, blk, 'variable' AS kind, arg_min('v' || CAST(event_id % 5 AS STRING), line_no) FILTER (y = 'click') AS name,
                    coalesce(arg_min('class C' || CAST(event_id % 3 AS STRING), line_no) FILTER (y = 'view'), '') AS location, min(st) AS line_no FROM i GROUP BY 1, 2)
       SELECT run_id, kind, name, location, CAST(min(line_no) AS INTEGER) AS line_no FROM f WHERE name IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
add(
    "c05_repair_cause",
    lambda t: G.repair_cause(
        t("events").selectExpr(
            "event_id", "CASE event_id % 3 WHEN 0 THEN 'TEST_FAILURE' WHEN 1 THEN 'COMPILATION_ERROR' ELSE 'ODD' END AS kind", "CASE WHEN event_id % 7 = 0 THEN 'x' END AS compiler",
            "CASE event_id % 11 WHEN 0 THEN '[BLOCKED] naming' WHEN 1 THEN 'a\\n[BLOCKED] Import x' WHEN 2 THEN '[BLOCKED] evidence' WHEN 3 THEN '[BLOCKED] schema' WHEN 4 THEN '[BLOCKED] other' WHEN 5 THEN 'naming' END AS patcher",
            "CASE WHEN event_id % 13 = 0 THEN 'variable' WHEN event_id % 13 = 1 THEN 'method' END AS missing_kind",
        )
    ).select("event_id", "cause"),
    """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'UNDECLARED_TEST_FIXTURE' WHEN event_id % 7 = 0 THEN 'COMPILER_ERROR' WHEN event_id % 11 = 0 THEN 'NAMING_OR_QUALITY_RULE' WHEN event_id % 11 = 1 THEN 'IMPORT_RULE'
              WHEN event_id % 11 = 2 THEN 'EVIDENCE_RULE' WHEN event_id % 11 = 3 THEN 'PATCH_DESCRIPTOR_RULE' WHEN event_id % 11 = 4 THEN 'PATCHER_GATE' WHEN event_id % 3 = 0 THEN 'ASSERTION_OR_RUNTIME'
              WHEN event_id % 3 = 1 THEN 'COMPILER_ERROR' ELSE 'UNKNOWN' END AS cause FROM events""",
)
add(
    "c11_undeclared_receivers",
    lambda t: G.undeclared_receivers(
        t("classes").selectExpr(
            "class_no", "concat('Foo foo = new Foo(); foo.run(); svc.go(', class_no % 3, '); ', CASE WHEN class_no % 2 = 0 THEN 'adapter.handle(); // ghost.x()' ELSE 'String s = \"ghost.x()\"; s.trim();' END) AS body",
            "CASE WHEN class_no % 3 = 0 THEN array('svc') END AS planned",
        )
    ).select("class_no", "undeclared"),
    """SELECT class_no, concat_ws(',', CASE WHEN class_no % 3 <> 0 THEN 'svc' END, CASE WHEN class_no % 2 = 0 THEN 'adapter' END) AS undeclared FROM classes""",
)
add(
    "p07_evidence_id", lambda t: t("members").select("evidence_id", S.evidence_id(F.col("kind"), F.concat("fqcn", F.lit("#"), "name")).alias("made")),
    "SELECT evidence_id, kind || ':' || left(sha256(fqcn || '#' || name), 8) AS made FROM members",
)
add(
    "p08_failure_hash", lambda t: t("failure_memory").select("event_id", S.failure_hash(F.col("error_code"), F.col("symbol_fqn"), F.col("fix_id")).alias("hash")),
    "SELECT event_id, sha256(error_code || chr(0) || symbol_fqn || chr(0) || fix_id) AS hash FROM failure_memory",
)
add(
    "p09_failure_signature",
    lambda t: t("events").select("event_id", S.failure_signature(F.col("event_type"), F.lit(" s "), F.concat(F.lit("1\n2\n3\n4\n5\n6"), F.col("props")), F.lit("x\n[BLOCKED] a\n[BLOCKED] b")).alias("signature")),
    """SELECT event_id, left(sha1(event_type || '||s||' || '1' || chr(10) || '2' || chr(10) || '3' || chr(10) || '4' || chr(10) || '5' || '||[BLOCKED] a' || chr(10) || '[BLOCKED] b'), 16) AS signature FROM events WHERE props IS NOT NULL
       UNION ALL SELECT event_id, left(sha1(event_type || '||s||||[BLOCKED] a' || chr(10) || '[BLOCKED] b'), 16) FROM events WHERE props IS NULL""",
)
add(
    "p22_target_method_name",
    lambda t: t("targets").select("target_id", S.target_method_name(F.when(F.col("pos") == 1, F.concat(F.lit("void "), S.simple_name(F.col("sut")), F.lit("(int)"))).when(F.col("pos") != 2, F.col("method")),
                                                                     F.col("sut"), F.concat("target_id", F.lit("#go(x)"))).alias("name")),
    "SELECT target_id, CASE pos WHEN 1 THEN '<init>' WHEN 2 THEN 'go' ELSE split_part(method, '(', 1) END AS name FROM targets",
)
add(
    "p24_sanitize_imports",
    lambda t: t("classes").selectExpr("class_no", "array('a.B', ' a.B ', '', NULL, 'c.*', concat('x.Y', class_no % 3), 'z.Q') AS i", "array('a.B', 'x.Y1', 'c.*') AS ok").select("class_no", F.array_join(S.sanitize_imports(F.col("i"), F.col("ok")), ",").alias("kept")),
    "SELECT class_no, CASE WHEN class_no % 3 = 1 THEN 'a.B,x.Y1' ELSE 'a.B' END AS kept FROM classes",
)
