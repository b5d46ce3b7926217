"""Which uncovered methods to test next: target ids, filters, enrichment, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import scalars as S
from .lineage import cut_lineage, settled


def target_ids(coverage: DataFrame, mode: str = "coverage", config: Config = DEFAULT) -> DataFrame:
    """W-1: number the targets of each repository in document order, after the mode's
    filter; ``score`` = 2 lines + 3 branches.  Needs repo, class_pos, method_pos (not
    null).  Classes are counted and targets numbered inside a class, so a repository's
    targets are never sorted in one task."""
    score = config.target_line_weight * F.col("missed_lines") + config.target_branch_weight * F.col("missed_branches")
    rows = filter_by_mode(coverage, mode)
    nth = F.row_number().over(Window.partitionBy("repo", "class_pos").orderBy("method_pos"))
    starts = _starts(rows, ["repo"], "class_pos")
    numbered = rows.withColumn("__nth", nth).join(starts.hint("merge"), ["repo", "class_pos"])
    return numbered.select(*coverage.columns, (F.col("__before") + F.col("__nth")).cast("int").alias("__n")).withColumn("target_id", F.format_string("tgt:%04d", "__n")).withColumn("score", score).drop("__n")


def _starts(rows: DataFrame, group: list[str], part: str) -> DataFrame:
    """``__before``: how many rows of the group stand in parts before this one."""
    counts = rows.groupBy(*group, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*group, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))


def _place(rows: DataFrame, group: list[str], by: str, chunk: int = 4096) -> DataFrame:
    """``__place``: the row's number in its group by a whole-number column, worked out in
    chunks of that column."""
    rows = rows.withColumn("__chunk", F.floor(F.col(by) / chunk))
    nth = F.row_number().over(Window.partitionBy(*group, "__chunk").orderBy(by))
    placed = rows.withColumn("__nth", nth).join(_starts(rows, group, "__chunk").hint("merge"), [*group, "__chunk"])
    return placed.withColumn("__place", F.col("__before") + F.col("__nth")).drop("__chunk", "__nth", "__before")


def filter_by_mode(targets: DataFrame, mode: str = "coverage") -> DataFrame:
    """F-1."""
    wanted = {"coverage": F.col("missed_lines") > 0, "branch-coverage": F.col("missed_branches") > 0, "mutation-hardening": F.lit(True)}
    return targets.filter(wanted[mode])


def exclude_generated(df: DataFrame, rules: DataFrame, *, col: str = "sut", boundary: bool = False) -> DataFrame:
    """F-2: anti join on exact names, then on package patterns.  With ``boundary`` a
    package ends at a dot and path globs are left out: a class is matched through each of
    its dotted prefixes.  Without it a pattern is an open prefix (``*`` is any text): what
    stands before its first ``*`` is looked up among the beginnings of a name, and only
    what meets there is tried as an expression.  Both joins are equi, however many the rules."""
    packages = rules.filter("rule_kind = 'package'")
    exact = rules.filter("rule_kind = 'fqcn'").select(F.col("pattern").alias(col))
    if boundary:
        names = packages.filter(~F.col("pattern").contains("/")).select(F.regexp_replace("pattern", r"(\.\*+|\.)$", "").alias("__prefix"), F.lit(False).alias("__whole"))
        named = names.unionByName(exact.select(F.col(col).alias("__prefix"), F.lit(True).alias("__whole"))).distinct()
        prefixes = df.select(col).distinct().withColumn("__prefix", F.explode(dotted_prefixes(F.col(col))))
        met = prefixes.join(named.hint("shuffle_hash"), "__prefix").filter(~F.col("__whole") | (F.col(col) == F.col("__prefix")))
        return df.join(met.select(col).distinct().hint("merge"), col, "left_anti")
    left = df.join(exact.distinct(), col, "left_anti")
    escaped = F.regexp_replace(F.regexp_replace("pattern", r"([.\[\](){}+?^$|\\])", r"\\$1"), r"\*", ".*")
    heads = packages.select(F.substring_index("pattern", "*", 1).alias("__head"), F.when(F.col("pattern").contains("*"), F.concat(F.lit("^"), escaped)).alias("__re")).distinct()
    # a pattern is looked up by its literal head among the name's own beginnings of that length
    lengths = sorted(r[0] for r in heads.select(F.length("__head")).distinct().collect())  # at most the longest pattern's letters
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(col)), lambda n: F.substring(F.col(col), F.lit(1), n))
    begun = left.select(col).distinct().withColumn("__head", F.explode(starts))
    met = begun.join(heads.hint("merge"), "__head").filter(F.col("__re").isNull() | F.expr(f"`{col}` rlike __re"))
    return left.join(met.select(col).distinct().hint("merge"), col, "left_anti")


def dotted_prefixes(c: Column) -> Column:
    """``a.b.C`` to [a, a.b, a.b.C]."""
    parts = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def exclude_types(targets: DataFrame, classification: DataFrame, types: tuple[str, ...] = ("generated", "generated/excluded")) -> DataFrame:
    """F-3."""
    bad = classification.filter(F.col("type").isin(*types)).select(F.col("fqcn").alias("sut")).distinct()
    return targets.join(bad, "sut", "left_anti")


def exclude_tests(df: DataFrame, col: str = "fqcn", with_case: bool = False) -> DataFrame:
    """F-4."""
    return df.filter(~S.is_test_name(F.col(col), with_case))


def filter_suts(targets: DataFrame, suts: DataFrame) -> DataFrame:
    """F-5: only the listed classes."""
    return targets.join(suts.select(F.col("fqcn").alias("sut")).distinct(), "sut", "left_semi")


def filter_incremental(targets: DataFrame, affected: DataFrame) -> DataFrame:
    """F-5: only affected classes; all, when none is affected."""
    some = affected.agg(F.count(F.lit(1)).alias("__some"))
    named = affected.select(F.col("fqcn").alias("sut"), F.lit(True).alias("__hit")).distinct()
    joined = targets.join(named, "sut", "left").join(F.broadcast(some), F.lit(True))
    return joined.filter((F.col("__some") == 0) | F.col("__hit")).select(*targets.columns)


def usable_members(members: DataFrame) -> DataFrame:
    """F-9."""
    return members.filter(F.coalesce("usable", F.lit(True)) & (F.col("visibility") != "private") & ~F.col("name").startswith("<"))


def drop_covered(scored: DataFrame) -> DataFrame:
    """F-10."""
    return scored.filter(~((F.col("plan_score") <= 0) & (F.col("missed_lines") == 0) & (F.col("missed_branches") == 0)))


def failure_penalties(memory: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A-2."""
    failed = memory.filter("last_result = 'FAILED'").withColumn("sut", F.substring_index("symbol_fqn", "#", 1))
    return failed.groupBy("sut").agg((config.failure_penalty * F.sum("attempts")).alias("penalty"))


def collapse_lambdas(targets: DataFrame) -> DataFrame:
    """A-3: misses of ``lambda$name$n`` go to the last target ``name`` of the class; a
    lambda without one becomes a target ``name()`` of its own, flagged."""
    name = F.regexp_extract("method", r"^lambda\$([A-Za-z_]\w*)\$\d+\(", 1)
    # by class, for the window and the look-ups by class that follow; what is told from the method is told after the shuffle
    parts = targets.repartition("sut").withColumn("__lambda", name).withColumn("__name", F.when(name != "", name).otherwise(F.substring_index("method", "(", 1)))
    is_lambda, alike = F.col("__lambda") != "", Window.partitionBy("sut", "repo", "__name")  # the look-ups use this order
    own = F.struct("pos", "target_id")
    seen = parts.withColumn("__parent", F.max(F.when(~is_lambda, own)).over(alike)).withColumn("__group", F.struct(
        F.sum(F.when(is_lambda, F.col("missed_lines"))).over(alike).alias("l"), F.sum(F.when(is_lambda, F.col("missed_branches"))).over(alike).alias("b"),
        F.array_sort(F.collect_list(F.when(is_lambda, own)).over(alike)).alias("from"),
    ))
    takes = own == F.col("__parent")  # not so for a lambda
    more = lambda part: F.when(takes, F.coalesce(F.col(f"__group.{part}"), F.lit(0))).otherwise(0)
    return seen.filter(~is_lambda | F.col("__parent").isNull()).select(
        "repo", "target_id", "sut", F.when(is_lambda, F.concat("__lambda", F.lit("()"))).otherwise(F.col("method")).alias("method"), "pos",
        (F.col("missed_lines") + F.coalesce(more("l"), F.lit(0))).alias("missed_lines"), (F.col("missed_branches") + F.coalesce(more("b"), F.lit(0))).alias("missed_branches"),
        F.when(takes, F.array_join(F.transform("__group.from", lambda x: x["target_id"]), ",")).otherwise("").alias("collapsed"), is_lambda.alias("fallback"),
    )


def enrich_targets(targets: DataFrame, classification: DataFrame, penalties: DataFrame, affected: DataFrame, fixtures: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """J-1: look-ups with defaults."""
    ids = fixtures.groupBy(F.col("fqcn").alias("sut")).agg(F.array_join(F.array_sort(F.collect_set("fixture_id")), ",").alias("fixture_ids"))
    return (
        targets.join(classification.select(F.col("fqcn").alias("sut"), "testability_risk", "template"), "sut", "left")
        .join(penalties, "sut", "left")
        .join(affected.select(F.col("fqcn").alias("sut")).distinct().withColumn("boost", F.lit(config.affected_boost)), "sut", "left")
        .join(ids, "sut", "left")
        .select(
            *targets.columns,
            F.coalesce("testability_risk", F.lit("medium")).alias("testability_risk"), "template",
            F.coalesce("penalty", F.lit(0)).cast("long").alias("penalty"), F.coalesce("boost", F.lit(0)).cast("long").alias("boost"),
            F.coalesce("fixture_ids", F.lit("")).alias("fixture_ids"),
        )
    )


def plan_score(config: Config = DEFAULT) -> Column:
    risk = F.lit(config.other_risk_penalty)
    for name, cost in config.risk_penalty.items():
        risk = F.when(F.col("testability_risk") == name, cost).otherwise(risk)
    any_miss = F.when((F.col("missed_lines") > 0) | (F.col("missed_branches") > 0), config.any_miss_weight).otherwise(0)
    gain = config.line_weight * F.col("missed_lines") + config.branch_weight * F.col("missed_branches") + any_miss
    return (gain - risk - F.col("penalty") + F.col("boost")).cast("long")


def plan(enriched: DataFrame, limit: int = 0, config: Config = DEFAULT) -> DataFrame:
    """W-2: score, drop what is covered, rank within each repository by score, class and
    input order (``target_id`` breaks ties); ``limit`` 0 keeps all; ``eligible`` counts
    before the limit.  Filters stand before the window, so only eligible rows are sorted,
    and a repository's rows are ranked score by score, not in one task."""
    scored = cut_lineage(drop_covered(enriched.withColumn("plan_score", plan_score(config))))  # read twice, worked out once
    inside = [F.col("sut"), F.col("pos"), F.col("target_id")]
    if limit:  # Spark drops what no task can need before it shuffles
        order = Window.partitionBy("repo").orderBy(F.desc("plan_score"), *inside)
        total = scored.groupBy("repo").agg(F.count(F.lit(1)).alias("eligible"))
        ranked = scored.withColumn("plan_rank", F.row_number().over(order)).filter(F.col("plan_rank") <= limit)
        return ranked.join(total.hint("shuffle_hash"), "repo")
    # rows of one score are ranked together; those of higher scores are only counted.  A missing score
    # or repository is a value like any other: the two are joined on as one that is never null
    by = F.struct("repo", "plan_score")
    counts = scored.groupBy("repo", "plan_score").agg(F.count(F.lit(1)).alias("__n"))
    higher = Window.partitionBy("repo").orderBy(F.desc("plan_score")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(by.alias("__by"), F.coalesce(F.sum("__n").over(higher), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("repo")).alias("eligible"))
    rows = scored.select(by.alias("__by"), *[c for c in scored.columns if c not in ("repo", "plan_score")])
    nth = F.row_number().over(Window.partitionBy("__by").orderBy(*inside))
    rows = rows.withColumn("__nth", nth).join(counts.hint("shuffle_hash"), "__by")
    own = [F.col(f"__by.{c}") if c in ("repo", "plan_score") else F.col(c) for c in scored.columns]
    return rows.select(*own, (F.col("__before") + F.col("__nth")).cast("int").alias("plan_rank"), "eligible")


def plan_by_class(enriched: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """W-2 for J-16: the targets of each class, joined in the order of ``plan``.  Targets of
    one repository stand in a class as in the plan by score and input order alone, so they
    are ranked only if a class lies in several repositories."""
    scored = drop_covered(enriched.withColumn("plan_score", plan_score(config)))
    place = F.struct(F.col("plan_score").isNull().alias("last"), (-F.col("plan_score")).alias("score"), "pos", "target_id")
    spread = ~F.min(F.struct("repo")).eqNullSafe(F.max(F.struct("repo")))
    rows = settled(scored.groupBy("sut").agg(_joined(F.collect_list(place)).alias("targets"), spread.alias("__spread")))
    if rows.filter("__spread").isEmpty():
        return rows.drop("__spread")
    return settled(targets_by_class(plan(settled(enriched), 0, config)))


def targets_by_class(planned: DataFrame) -> DataFrame:
    """The targets of each class, joined by their ranks."""
    return planned.groupBy("sut").agg(_joined(F.collect_list(F.struct("plan_rank", "target_id"))).alias("targets"))


def _joined(places: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["target_id"]), ";")


def top_suts(planned: DataFrame, n: int) -> DataFrame:
    """W-16: the first n targets of each plan."""
    return planned.filter(F.col("plan_rank") <= n)


def capped_errors(errors: DataFrame, most: int = DEFAULT.errors_kept) -> DataFrame:
    """W-16: the first errors of each run, with how many there were and are kept."""
    order = Window.partitionBy("run_id").orderBy("pos")
    total = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    return errors.withColumn("nth", F.row_number().over(order)).withColumn("total", total).filter(F.col("nth") <= most).withColumn("kept", F.least("total", F.lit(most)))


def batches(planned: DataFrame, size: int, *, type_caps: dict[str, int] | None = None, one_class_a_batch: bool = False) -> DataFrame:
    """W-11: consecutive slices of the plan.  Type caps limit a type's rows in a batch
    (later rows of the type move on); with ``one_class_a_batch`` the nth targets of all
    classes come before the n+1st, and a batch never spans two such rounds.  Rows are
    numbered in chunks; only batches, not rows, are sorted a repository."""
    # each step is worked out once: it is read for its rows, for their counts, and for the batches
    rows = cut_lineage(planned) if type_caps or one_class_a_batch else planned
    if type_caps:
        cap = F.lit(size)
        for name, n in type_caps.items():
            cap = F.when(F.col("type") == name, n).otherwise(cap)
        typed = rows.withColumn("type", F.coalesce("type", F.lit("")))
        rows = cut_lineage(_place(typed, ["repo", "type"], "plan_rank").withColumn("__turn", F.floor((F.col("__place") - 1) / cap)).drop("__place"))
        rows = cut_lineage(_place(rows, ["repo", "__turn"], "plan_rank"))
    elif one_class_a_batch:
        rows = rows.withColumn("__turn", F.row_number().over(Window.partitionBy("repo", "sut").orderBy("plan_rank")) - 1)
        rows = cut_lineage(_place(cut_lineage(rows), ["repo", "__turn"], "plan_rank"))
    else:
        rows = rows.withColumn("__turn", F.lit(0)).withColumn("__place", F.col("plan_rank"))
    rows = rows.withColumn("__slice", F.floor((F.col("__place") - 1) / size)).drop("__place")
    number = F.row_number().over(Window.partitionBy("repo").orderBy("__turn", "__slice"))
    named = rows.select("repo", "__turn", "__slice").distinct().withColumn("batch_id", F.format_string("batch-%03d", number))
    return rows.join(named.hint("merge"), ["repo", "__turn", "__slice"]).select(*planned.columns, "batch_id")


def select_unprocessed(planned: DataFrame, processed: DataFrame, n: int) -> DataFrame:
    """J-8: the next n targets of each plan that are not processed yet."""
    open_ = planned.filter(F.col("target_id").isNotNull()).join(processed.select("target_id").distinct(), "target_id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("repo").orderBy("plan_rank"))
    return open_.withColumn("next", nth).filter(F.col("next") <= n)
