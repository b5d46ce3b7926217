"""Coverage before and after, reports over it, and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT

COUNTERS = ("lines", "branches")


def coverage_delta(coverage: DataFrame) -> DataFrame:
    """J-2: per class, covered lines and branches before, after and their difference.  A
    side without the class counts as 0.  Both sides are one table of snapshots, so the
    full outer join is one conditional aggregate: a single shuffle."""
    sums = [
        F.coalesce(F.sum(F.when(F.col("snapshot") == side, F.col(f"covered_{c}"))), F.lit(0)).alias(f"{c}_{side}")
        for c in COUNTERS for side in ("before", "after")
    ]
    wide = coverage.filter(F.col("snapshot").isin("before", "after")).groupBy("repo", "fqcn").agg(*sums)
    return wide.select("*", *[(F.col(f"{c}_after") - F.col(f"{c}_before")).alias(f"{c}_delta") for c in COUNTERS])


def coverage_totals(delta: DataFrame) -> DataFrame:
    """A-1."""
    return delta.groupBy("repo").agg(*[F.sum(f"{c}_{s}").alias(f"{c}_{s}") for c in COUNTERS for s in ("before", "after", "delta")])


def attribute_delta(delta: DataFrame, tests: DataFrame) -> DataFrame:
    """J-21: the tests whose class changed."""
    changed = delta.filter("lines_delta <> 0 OR branches_delta <> 0")
    named = tests.groupBy(F.col("sut").alias("fqcn")).agg(F.array_join(F.array_sort(F.collect_set("test_case_id")), ",").alias("tests"))
    return changed.join(named, "fqcn", "left").withColumn("tests", F.coalesce("tests", F.lit("")))


def sut_report(tests: DataFrame, delta: DataFrame) -> DataFrame:
    """A-7: counts of test cases, and coverage deltas rounded to 4 (NULL without a row)."""
    counted = tests.groupBy("sut").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "FAIL", "SKIP")],
        F.sum("errors").alias("errors"), F.sum("repairs").alias("repairs"),
    )
    status = (
        F.when(F.col("pass") == F.col("total"), "PASS").when((F.col("pass") > 0) & (F.col("fail") > 0), "PARTIAL").when(F.col("fail") > 0, "FAIL")
        .when(F.col("skip") == F.col("total"), "SKIP").otherwise("PARTIAL")
    )
    side = delta.groupBy(F.col("fqcn").alias("sut")).agg(*[F.sum(f"{c}_delta").alias(f"{c}_delta") for c in COUNTERS])
    return counted.withColumn("status", status).join(side, "sut", "left").select(
        "sut", "total", "pass", "fail", "skip", "errors", "repairs", "status", *[F.bround(F.col(f"{c}_delta").cast("double"), 4).alias(f"{c}_delta") for c in COUNTERS]
    )


def cycle_summary(report: DataFrame) -> DataFrame:
    """A-8: one row of sums, counts and gates."""
    return report.agg(
        F.count(F.lit(1)).alias("suts"), F.sum("total").alias("test_cases"), F.sum("errors").alias("errors"), F.sum("repairs").alias("repairs"),
        *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_suts") for s in ("PASS", "PARTIAL", "FAIL", "SKIP")],
        (F.coalesce(F.sum("lines_delta"), F.lit(0.0)) > 0).alias("improved"),
        F.coalesce(F.bool_and(F.coalesce("lines_delta", F.lit(0.0)) >= 0), F.lit(True)).alias("no_regression"),
        (F.coalesce(F.sum("errors"), F.lit(0)) == 0).alias("compile_clean"),
    )


def recommendations(report: DataFrame, fixtures: DataFrame, totals: DataFrame, most: int = DEFAULT.recommendations) -> DataFrame:
    """A-9: five rules in a fixed priority, class order within a rule, the first few.
    Per class: coverage fell, no fixtures, many repairs and still failing; overall:
    coverage did not move, every class is skipped.  ``fixtures``: fqcn; ``totals``: A-1."""
    some = fixtures.select(F.col("fqcn").alias("sut"), F.lit(True).alias("__fixture")).distinct()
    rules = [
        ("regression", F.coalesce("lines_delta", F.lit(0.0)) < 0),
        ("no-fixtures", F.col("__fixture").isNull()),
        ("too-many-repairs", (F.col("repairs") >= 3) & (F.col("fail") > 0)),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("priority"), F.lit(n).alias("rule"))) for i, (n, c) in enumerate(rules)]))
    rows = report.join(some, "sut", "left").select("sut", F.explode(hits).alias("x")).select("x.priority", "x.rule", "sut")
    flat = totals.agg(F.sum("lines_delta").alias("l"), F.sum("branches_delta").alias("b")).filter("l = 0 AND b = 0")
    skipped = report.agg(F.bool_and(F.col("status") == "SKIP").alias("s")).filter("s")
    overall = lambda df, i, n: df.select(F.lit(i).alias("priority"), F.lit(n).alias("rule"), F.lit("").alias("sut"))
    all_ = rows.unionByName(overall(flat, 3, "no-improvement")).unionByName(overall(skipped, 4, "all-skipped"))
    return all_.orderBy("priority", "sut").limit(most)


def class_breakdown(classification: DataFrame) -> DataFrame:
    """A-10: classes of each type."""
    return classification.groupBy("type").agg(F.count(F.lit(1)).alias("classes"))


def coverage_universe(targets: DataFrame, classification: DataFrame) -> DataFrame:
    """A-10: real and generated targets, with their misses."""
    bad = classification.filter(F.col("type").isin("generated", "generated/excluded")).select(F.col("fqcn").alias("sut"), F.lit(True).alias("g")).distinct()
    kind = F.when(F.col("g"), "generated").otherwise("real")
    return targets.join(bad, "sut", "left").groupBy(kind.alias("universe")).agg(
        F.count(F.lit(1)).alias("targets"), F.sum("missed_lines").alias("missed_lines"), F.sum("missed_branches").alias("missed_branches")
    )


def per_sut_rollup(targets: DataFrame) -> DataFrame:
    """A-10: per class, and by rollup per repository and overall."""
    return targets.rollup("repo", "sut").agg(
        F.count(F.lit(1)).alias("targets"), F.sum("missed_lines").alias("missed_lines"), F.sum("missed_branches").alias("missed_branches")
    )


def dedupe_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """W-6: the first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def delta_scope(targets: DataFrame, affected: DataFrame) -> DataFrame:
    """X-1: classes that are both targets and affected."""
    return targets.select(F.col("sut").alias("fqcn")).intersect(affected.select("fqcn"))


def affected_modules(changed: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """X-2: first path components, hidden ones left out, within the selected modules."""
    first = changed.select(F.substring_index("path", "/", 1).alias("module")).filter("module <> '' AND NOT startswith(module, '.')")
    return first.intersect(modules.select("module")) if modules is not None else first.distinct()


def import_difference(declared: DataFrame, allowed: DataFrame) -> DataFrame:
    """X-3: declared names that are not allowed."""
    return declared.join(allowed, declared.columns, "left_anti").distinct()


def stable_fingerprint(df: DataFrame, volatile: tuple[str, ...] = ("generatedAt", "generated_at")) -> DataFrame:
    """P-19: SHA-256 of each row's content, volatile columns left out."""
    kept = sorted(c for c in df.columns if c not in volatile)
    return df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}), 256))


def table_fingerprint(df: DataFrame, volatile: tuple[str, ...] = ("generatedAt", "generated_at")) -> DataFrame:
    """P-19 for a table: independent of row order and partitioning, one row per task
    moves: the sum of 128 bits of the rows' hashes, and their number."""
    rows = stable_fingerprint(df, volatile)
    part = lambda at: F.sum(F.conv(F.substring("fingerprint", at, 15), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", part(1), part(16), F.count(F.lit(1))), 256).alias("fingerprint"))


def fingerprint_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """X-4: each key as added, removed, changed or unchanged."""
    a = stable_fingerprint(old).select(*keys, F.col("fingerprint").alias("__old"))
    b = stable_fingerprint(new).select(*keys, F.col("fingerprint").alias("__new"))
    change = (
        F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed")
        .when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    )
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


