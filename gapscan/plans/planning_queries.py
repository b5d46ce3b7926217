"""Planning, coverage deltas and reports."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import delta as D
from ..operators import planning as P
from .catalog import CATALOG

add = CATALOG.add

_LAMBDA = """
    named AS (
        SELECT *, regexp_extract(method, '^lambda\\$([A-Za-z_][A-Za-z0-9_]*)\\$[0-9]+\\(', 1) AS lam FROM targets
    ), keyed AS (SELECT *, CASE WHEN lam <> '' THEN lam ELSE split_part(method, '(', 1) END AS nm FROM named),
    parents AS (SELECT repo, sut, nm, arg_max(target_id, pos) AS parent FROM keyed WHERE lam = '' GROUP BY ALL),
    tied AS (SELECT k.*, p.parent FROM keyed k LEFT JOIN parents p USING (repo, sut, nm) WHERE lam <> ''),
    folded AS (
        SELECT parent AS target_id, SUM(missed_lines) AS l, SUM(missed_branches) AS b, string_agg(target_id, ',' ORDER BY pos, target_id) AS f
        FROM tied WHERE parent IS NOT NULL GROUP BY parent
    ), collapsed AS (
        SELECT repo, target_id, sut, method, pos, CAST(missed_lines + coalesce(l, 0) AS BIGINT) AS missed_lines,
               CAST(missed_branches + coalesce(b, 0) AS BIGINT) AS missed_branches, coalesce(f, '') AS collapsed, FALSE AS fallback
        FROM keyed LEFT JOIN folded USING (target_id) WHERE lam = ''
        UNION ALL SELECT repo, target_id, sut, lam || '()', pos, missed_lines, missed_branches, '', TRUE FROM tied WHERE parent IS NULL
    )"""
_PENALTY = """
    penalties AS (
        SELECT split_part(symbol_fqn, '#', 1) AS sut, CAST(5 * SUM(attempts) AS BIGINT) AS penalty FROM failure_memory WHERE last_result = 'FAILED' GROUP BY 1
    )"""
_ENRICH = f"""{_PENALTY}, fx AS (SELECT fqcn AS sut, string_agg(DISTINCT fixture_id, ',' ORDER BY fixture_id) AS fixture_ids FROM fixtures GROUP BY 1),
    boosted AS (SELECT DISTINCT fqcn AS sut, 20 AS boost FROM affected),
    enriched AS (
        SELECT t.*, coalesce(c.testability_risk, 'medium') AS testability_risk, c.template, CAST(coalesce(p.penalty, 0) AS BIGINT) AS penalty,
               CAST(coalesce(b.boost, 0) AS BIGINT) AS boost, coalesce(f.fixture_ids, '') AS fixture_ids
        FROM collapsed t LEFT JOIN classification c ON c.fqcn = t.sut LEFT JOIN penalties p USING (sut) LEFT JOIN boosted b USING (sut) LEFT JOIN fx f USING (sut)
    )"""
_PLAN = """
    scored AS (
        SELECT *, CAST(3 * missed_lines + 5 * missed_branches + CASE WHEN missed_lines > 0 OR missed_branches > 0 THEN 2 ELSE 0 END
               - CASE testability_risk WHEN 'high' THEN 30 WHEN 'medium' THEN 10 WHEN 'low' THEN 0 ELSE 10 END - penalty + boost AS BIGINT) AS plan_score
        FROM enriched
    ), planned AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY plan_score DESC, sut, pos, target_id) AS INTEGER) AS plan_rank,
               count(*) OVER (PARTITION BY repo) AS eligible
        FROM scored WHERE NOT (plan_score <= 0 AND missed_lines = 0 AND missed_branches = 0)
    )"""
_EXCLUDED = """
    kept AS (
        SELECT t.* FROM targets t WHERE missed_lines > 0 AND sut NOT IN (SELECT fqcn FROM classification WHERE type IN ('generated', 'generated/excluded'))
    )"""


def _collapsed(t):
    return P.collapse_lambdas(t("targets"))


def _enriched(t):
    return P.enrich_targets(_collapsed(t), t("classification"), P.failure_penalties(t("failure_memory")), t("affected"), t("fixtures"))


def flagship(t):
    """Which uncovered methods should be tested next, in every repository."""
    targets = P.exclude_types(P.filter_by_mode(_collapsed(t)), t("classification"))
    targets = P.exclude_generated(targets, t("generated_rules"), boundary=True)
    rich = P.enrich_targets(targets, t("classification"), P.failure_penalties(t("failure_memory")), t("affected"), t("fixtures"))
    return P.plan(rich, 50)


add(
    "flagship_next_targets", flagship,
    f"""WITH {_LAMBDA}, {_ENRICH.replace("FROM collapsed t", '''FROM (
            SELECT * FROM collapsed WHERE missed_lines > 0 AND sut NOT IN (SELECT fqcn FROM classification WHERE type IN ('generated', 'generated/excluded'))
              AND sut NOT IN (SELECT pattern FROM generated_rules WHERE rule_kind = 'fqcn')
              AND NOT EXISTS (SELECT 1 FROM generated_rules g WHERE rule_kind = 'package' AND (sut = pattern OR starts_with(sut, pattern || '.')))) t''')}, {_PLAN}
    SELECT * FROM planned WHERE plan_rank <= 50""",
)
add("f01_filter_by_mode", lambda t: P.filter_by_mode(t("targets"), "branch-coverage"), "SELECT * FROM targets WHERE missed_branches > 0")
add(
    "w01_target_ids",
    lambda t: P.target_ids(t("targets").withColumn("class_pos", F.col("sut")).withColumn("method_pos", F.col("pos"))).select("repo", "sut", "pos", "target_id", "score"),
    """SELECT repo, sut, pos, printf('tgt:%04d', row_number() OVER (PARTITION BY repo ORDER BY sut, pos)) AS target_id,
              2 * missed_lines + 3 * missed_branches AS score FROM targets WHERE missed_lines > 0""",
)
add(
    "f02_exclude_generated", lambda t: P.exclude_generated(t("targets"), t("generated_rules")),
    """SELECT * FROM targets t WHERE sut NOT IN (SELECT pattern FROM generated_rules WHERE rule_kind = 'fqcn')
       AND NOT EXISTS (SELECT 1 FROM generated_rules g WHERE rule_kind = 'package' AND starts_with(t.sut, g.pattern))""",
)
add(
    "f02_exclude_generated_boundary", lambda t: P.exclude_generated(t("targets"), t("generated_rules"), boundary=True),
    """SELECT * FROM targets t WHERE sut NOT IN (SELECT pattern FROM generated_rules WHERE rule_kind = 'fqcn')
       AND NOT EXISTS (SELECT 1 FROM generated_rules g WHERE rule_kind = 'package' AND (t.sut = g.pattern OR starts_with(t.sut, g.pattern || '.')))""",
)
add(
    "f03_exclude_types", lambda t: P.exclude_types(P.filter_by_mode(t("targets")), t("classification")),
    f"WITH {_EXCLUDED} SELECT * FROM kept",
)
add("f04_exclude_tests", lambda t: P.exclude_tests(t("classes")), "SELECT * FROM classes WHERE NOT regexp_matches(fqcn, '(Test|Tests|IT|Spec|Specs)$')")
add("f05_filter_suts", lambda t: P.filter_suts(t("targets"), t("affected")), "SELECT * FROM targets WHERE sut IN (SELECT fqcn FROM affected)")
add("f05_filter_incremental", lambda t: P.filter_incremental(t("targets"), t("affected")), "SELECT * FROM targets WHERE sut IN (SELECT fqcn FROM affected)")
add(
    "f05_filter_incremental_none", lambda t: P.filter_incremental(t("targets"), t("affected").filter("fqcn = ''")),
    "SELECT * FROM targets",
)
add(
    "f09_usable_members", lambda t: P.usable_members(t("members")),
    "SELECT * FROM members WHERE coalesce(usable, TRUE) AND visibility <> 'private' AND NOT starts_with(name, '<')",
)
add("a02_failure_penalties", lambda t: P.failure_penalties(t("failure_memory")), f"WITH {_PENALTY} SELECT * FROM penalties")
add("a03_collapse_lambdas", _collapsed, f"WITH {_LAMBDA} SELECT * FROM collapsed")
add("j01_enrich_targets", _enriched, f"WITH {_LAMBDA}, {_ENRICH} SELECT * FROM enriched")
add("w02_plan", lambda t: P.plan(_enriched(t)), f"WITH {_LAMBDA}, {_ENRICH}, {_PLAN} SELECT * FROM planned")
add(
    "f10_drop_covered", lambda t: P.drop_covered(_enriched(t).withColumn("plan_score", P.plan_score())).select("target_id", "plan_score"),
    f"WITH {_LAMBDA}, {_ENRICH}, {_PLAN} SELECT target_id, plan_score FROM planned",
)
add("w16_top_suts", lambda t: P.top_suts(P.plan(_enriched(t)), 10), f"WITH {_LAMBDA}, {_ENRICH}, {_PLAN} SELECT * FROM planned WHERE plan_rank <= 10")
add(
    "w11_batches", lambda t: P.batches(P.plan(_enriched(t)), 7).select("repo", "target_id", "batch_id"),
    f"""WITH {_LAMBDA}, {_ENRICH}, {_PLAN} SELECT repo, target_id, printf('batch-%03d', CAST(floor((plan_rank - 1) / 7) + 1 AS BIGINT)) AS batch_id FROM planned""",
)
add(
    "w11_batches_one_class", lambda t: P.batches(P.plan(_enriched(t)).select("repo", "target_id", "sut", "plan_rank"), 50, one_class_a_batch=True).select("repo", "target_id", "batch_id"),
    f"""WITH {_LAMBDA}, {_ENRICH}, {_PLAN}, r AS (SELECT *, row_number() OVER (PARTITION BY repo, sut ORDER BY plan_rank) AS turn FROM planned),
        s AS (SELECT *, floor((row_number() OVER (PARTITION BY repo, turn ORDER BY plan_rank) - 1) / 50) AS sl FROM r)
        SELECT repo, target_id, printf('batch-%03d', dense_rank() OVER (PARTITION BY repo ORDER BY turn, sl)) AS batch_id FROM s""",
)
_CAPS = {"service": 3, "controller": 2}


def _typed(t):
    return P.plan(_enriched(t)).join(t("classification").select(F.col("fqcn").alias("sut"), "type"), "sut", "left").withColumn("type", F.coalesce("type", F.lit("")))


add(
    "w11_batches_type_caps", lambda t: P.batches(_typed(t).select("repo", "target_id", "type", "plan_rank"), 7, type_caps=_CAPS).select("repo", "target_id", "type", "batch_id"),
    f"""WITH {_LAMBDA}, {_ENRICH}, {_PLAN}, ty AS (SELECT p.*, coalesce(c.type, '') AS type FROM planned p LEFT JOIN classification c ON c.fqcn = p.sut),
        tu AS (SELECT *, floor((row_number() OVER (PARTITION BY repo, type ORDER BY plan_rank) - 1) / CASE type WHEN 'service' THEN 3 WHEN 'controller' THEN 2 ELSE 7 END) AS turn FROM ty),
        sl AS (SELECT *, floor((row_number() OVER (PARTITION BY repo, turn ORDER BY plan_rank) - 1) / 7) AS slice FROM tu)
        SELECT repo, target_id, type, printf('batch-%03d', dense_rank() OVER (PARTITION BY repo ORDER BY turn, slice)) AS batch_id FROM sl""",
)
add(
    "w16_capped_errors",
    lambda t: P.capped_errors(t("failure_memory").select(F.col("test_case_id").alias("run_id"), F.col("event_id").alias("pos"), "error_code"), 5).select("run_id", "pos", "error_code", "nth", "total", "kept"),
    """WITH n AS (SELECT test_case_id AS run_id, event_id AS pos, error_code, CAST(row_number() OVER (PARTITION BY test_case_id ORDER BY event_id) AS INTEGER) AS nth, count(*) OVER (PARTITION BY test_case_id) AS total FROM failure_memory)
       SELECT *, least(total, 5) AS kept FROM n WHERE nth <= 5""",
)
add(
    "j08_select_unprocessed",
    lambda t: P.select_unprocessed(P.plan(_enriched(t)), t("targets").filter("pos = 1").select("target_id"), 20).select("repo", "target_id", "next"),
    f"""WITH {_LAMBDA}, {_ENRICH}, {_PLAN}, o AS (
            SELECT repo, target_id, CAST(row_number() OVER (PARTITION BY repo ORDER BY plan_rank) AS INTEGER) AS next FROM planned
            WHERE target_id NOT IN (SELECT target_id FROM targets WHERE pos = 1))
        SELECT * FROM o WHERE next <= 20""",
)

_DELTA = """
    delta AS (
        SELECT repo, fqcn, CAST(SUM(CASE snapshot WHEN 'before' THEN covered_lines ELSE 0 END) AS BIGINT) AS lines_before,
               CAST(SUM(CASE snapshot WHEN 'after' THEN covered_lines ELSE 0 END) AS BIGINT) AS lines_after,
               CAST(SUM(CASE snapshot WHEN 'before' THEN covered_branches ELSE 0 END) AS BIGINT) AS branches_before,
               CAST(SUM(CASE snapshot WHEN 'after' THEN covered_branches ELSE 0 END) AS BIGINT) AS branches_after,
               CAST(lines_after - lines_before AS BIGINT) AS lines_delta, CAST(branches_after - branches_before AS BIGINT) AS branches_delta
        FROM coverage GROUP BY repo, fqcn
    )"""
_REPORT = """
    counted AS (
        SELECT sut, count(*) AS total, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'SKIP') AS skip,
               CAST(SUM(errors) AS BIGINT) AS errors, CAST(SUM(repairs) AS BIGINT) AS repairs FROM test_cases GROUP BY sut
    ), report AS (
        SELECT c.*, CASE WHEN pass = total THEN 'PASS' WHEN pass > 0 AND fail > 0 THEN 'PARTIAL' WHEN fail > 0 THEN 'FAIL' WHEN skip = total THEN 'SKIP' ELSE 'PARTIAL' END AS status,
               CAST(d.l AS DOUBLE) AS lines_delta, CAST(d.b AS DOUBLE) AS branches_delta
        FROM counted c LEFT JOIN (SELECT fqcn AS sut, SUM(lines_delta) AS l, SUM(branches_delta) AS b FROM delta GROUP BY 1) d USING (sut)
    )"""


def _delta(t):
    return D.coverage_delta(t("coverage"))


def _report(t):
    return D.sut_report(t("test_cases"), _delta(t))


add("j02_coverage_delta", _delta, f"WITH {_DELTA} SELECT * FROM delta")
add(
    "a01_coverage_totals", lambda t: D.coverage_totals(_delta(t)),
    f"""WITH {_DELTA} SELECT repo, {", ".join(f"CAST(SUM({c}_{s}) AS BIGINT) AS {c}_{s}" for c in ("lines", "branches") for s in ("before", "after", "delta"))} FROM delta GROUP BY repo""",
)
add(
    "j21_attribute_delta", lambda t: D.attribute_delta(_delta(t), t("test_cases")),
    f"""WITH {_DELTA} SELECT d.*, coalesce(x.tests, '') AS tests FROM delta d
        LEFT JOIN (SELECT sut AS fqcn, string_agg(DISTINCT test_case_id, ',' ORDER BY test_case_id) AS tests FROM test_cases GROUP BY 1) x USING (fqcn)
        WHERE lines_delta <> 0 OR branches_delta <> 0""",
)
add("a07_sut_report", _report, f"WITH {_DELTA}, {_REPORT} SELECT * FROM report")
add(
    "a08_cycle_summary", lambda t: D.cycle_summary(_report(t)),
    f"""WITH {_DELTA}, {_REPORT} SELECT count(*) AS suts, CAST(SUM(total) AS BIGINT) AS test_cases, CAST(SUM(errors) AS BIGINT) AS errors, CAST(SUM(repairs) AS BIGINT) AS repairs,
        {", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}_suts" for s in ("PASS", "PARTIAL", "FAIL", "SKIP"))},
        coalesce(SUM(lines_delta), 0) > 0 AS improved, coalesce(bool_and(coalesce(lines_delta, 0) >= 0), TRUE) AS no_regression, coalesce(SUM(errors), 0) = 0 AS compile_clean FROM report""",
)
add(
    "a09_recommendations", lambda t: D.recommendations(_report(t), t("fixtures"), D.coverage_totals(_delta(t))),
    f"""WITH {_DELTA}, {_REPORT}, hits AS (
        SELECT 0 AS priority, 'regression' AS rule, sut FROM report WHERE coalesce(lines_delta, 0) < 0 UNION ALL SELECT 1, 'no-fixtures', sut FROM report WHERE sut NOT IN (SELECT fqcn FROM fixtures)
        UNION ALL SELECT 2, 'too-many-repairs', sut FROM report WHERE repairs >= 3 AND fail > 0 UNION ALL SELECT 3, 'no-improvement', '' FROM (SELECT SUM(lines_delta) AS l, SUM(branches_delta) AS b FROM delta) WHERE l = 0 AND b = 0
        UNION ALL SELECT 4, 'all-skipped', '' FROM (SELECT bool_and(status = 'SKIP') AS s FROM report) WHERE s)
        SELECT * FROM hits ORDER BY priority, sut LIMIT 5""",
)
add("a10_class_breakdown", lambda t: D.class_breakdown(t("classification")), "SELECT type, count(*) AS classes FROM classification GROUP BY type")
add(
    "a10_coverage_universe", lambda t: D.coverage_universe(t("targets"), t("classification")),
    """SELECT CASE WHEN c.fqcn IS NULL THEN 'real' ELSE 'generated' END AS universe, count(*) AS targets, CAST(SUM(missed_lines) AS BIGINT) AS missed_lines,
              CAST(SUM(missed_branches) AS BIGINT) AS missed_branches
       FROM targets t LEFT JOIN (SELECT DISTINCT fqcn FROM classification WHERE type IN ('generated', 'generated/excluded')) c ON c.fqcn = t.sut GROUP BY 1""",
)
add(
    "a10_per_sut_rollup", lambda t: D.per_sut_rollup(t("targets")),
    """SELECT repo, sut, count(*) AS targets, CAST(SUM(missed_lines) AS BIGINT) AS missed_lines, CAST(SUM(missed_branches) AS BIGINT) AS missed_branches
       FROM targets GROUP BY ROLLUP (repo, sut)""",
)
add(
    "w06_dedupe_first", lambda t: D.dedupe_first(t("responses"), ["target_id"], ["pos"]),
    "SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY pos) = 1",
)
add("x01_delta_scope", lambda t: D.delta_scope(t("targets"), t("affected")), "SELECT sut AS fqcn FROM targets INTERSECT SELECT fqcn FROM affected")
add(
    "x02_affected_modules", lambda t: D.affected_modules(t("source_files")),
    "SELECT DISTINCT split_part(path, '/', 1) AS module FROM source_files WHERE split_part(path, '/', 1) <> '' AND NOT starts_with(path, '.')",
)
add(
    "x03_import_difference", lambda t: D.import_difference(t("imports").select("import"), t("whitelist").select(F.col("name").alias("import"))),
    "SELECT import FROM imports EXCEPT SELECT name FROM whitelist",
)
add(
    "p19_stable_fingerprint", lambda t: D.stable_fingerprint(t("fixtures")),
    """SELECT *, sha256('{"fixture_id":"' || fixture_id || '","fqcn":"' || fqcn || '","strategy":"' || strategy || '"}') AS fingerprint FROM fixtures""",
)
add(
    "p19_table_fingerprint", lambda t: D.table_fingerprint(t("classes")),
    """WITH r AS (SELECT sha256('{"annotation":' || coalesce('"' || annotation || '"', 'null') || ',"class_no":' || CAST(class_no AS STRING) || ',"fqcn":"' || fqcn || '","is_abstract":' || CAST(is_abstract AS STRING)
                              || ',"kind":"' || kind || '","repo":"' || repo || '"}') AS h FROM classes),
       s AS (SELECT count(*) AS n, CAST(SUM(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS STRING) AS a, CAST(SUM(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS STRING) AS b FROM r)
       SELECT n, sha256(a || ':' || b || ':' || CAST(n AS STRING)) AS fingerprint FROM s""",
)
add(
    "x04_fingerprint_diff",
    lambda t: D.fingerprint_diff(
        t("classes").filter("class_no % 9 <> 0").select("fqcn", "kind"),
        t("classes").filter("class_no % 7 <> 0").select("fqcn", F.when(F.col("class_no") % 5 == 0, F.lit("x")).otherwise(F.col("kind")).alias("kind")), ["fqcn"],
    ),
    """SELECT coalesce(a.fqcn, b.fqcn) AS fqcn, CASE WHEN a.fqcn IS NULL THEN 'added' WHEN b.fqcn IS NULL THEN 'removed' WHEN a.kind = b.kind THEN 'unchanged' ELSE 'changed' END AS change
       FROM (SELECT fqcn, kind FROM classes WHERE class_no % 9 <> 0) a
       FULL JOIN (SELECT fqcn, CASE WHEN class_no % 5 = 0 THEN 'x' ELSE kind END AS kind FROM classes WHERE class_no % 7 <> 0) b ON a.fqcn = b.fqcn""",
)
add(
    "p01_names", lambda t: t("classes").select("fqcn", S.simple_name(F.col("fqcn")).alias("simple_name"), S.package_of(F.col("fqcn")).alias("package"), S.camel(F.col("fqcn")).alias("field")),
    """SELECT fqcn, regexp_extract(fqcn, '([^.]*)$', 1) AS simple_name, regexp_extract(fqcn, '^(.*)\\.[^.]*$', 1) AS package,
              lower(substr(regexp_extract(fqcn, '([^.]*)$', 1), 1, 1)) || substr(regexp_extract(fqcn, '([^.]*)$', 1), 2) AS field FROM classes""",
)
