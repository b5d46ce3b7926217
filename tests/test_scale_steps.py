"""Steps whose cost a larger table showed."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapscan.functions.java_code import SLICE_BYTES, read_code, read_tests, slices
from gapscan.operators import corpus as C
from gapscan.operators import lineage
from gapscan.operators import planning as P
from gapscan.operators import symbols as Y
from gapscan.plans import catalog
from gapscan.plans import corpus_queries as Q
from gapscan.plans.adapters import Tables
from gapscan.sources import ingest as I

SF = "/root/testdata/sf0.001"


def test_common_names_and_rare_ones_give_the_same_tests(spark, monkeypatch):
    imports = spark.createDataFrame([("A", "com.x.K.m"), ("B", "com.y.L"), ("C", "com.z"), ("D", "org.q")], "test string, import string")
    edges = spark.createDataFrame([("E", "com.y.L"), ("F", "no")], "src string, dst string")
    for names, want in ((["com.x.K", "com.y.L"], set("ABE")), (["com"], set("ABC")), (["none"], set())):
        affected = spark.createDataFrame([(n,) for n in names], "fqcn string")
        for most in (1, 2, 1000):
            monkeypatch.setattr(Y, "COMMON_NAMES", most)
            assert {r.test for r in Y.affected_tests(imports, edges, affected).collect()} == want


def test_state_documents_lie_in_one_flat_folder(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(Q, "scratch", lambda s, name: str(tmp_path / name))
    t = Tables(spark, SF)
    assert Q._state_documents(t)[0].select("id", "kind").collect()
    assert not any(p.is_dir() for p in (tmp_path / "state").iterdir())
    assert len(list((tmp_path / "state").glob("part-*"))) == t("supplier").count()


def test_xml_documents_have_a_bounded_number_of_elements(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(Q, "scratch", lambda s, name: str(tmp_path / name))
    path = Path(Q._written_xml(Tables(spark, SF), spark.range(25, numPartitions=1).selectExpr("id AS _id", "'x' AS v"), "e", "xml", 10))
    texts = [p.read_text() for p in path.glob("part-*")]
    assert sorted(x.count("<e ") for x in texts) == [5, 10, 10] and all(x.count("<root>") == x.count("</root>") == 1 for x in texts)


def test_survivors_are_written_and_read_without_a_shuffle(spark, monkeypatch, tmp_path):
    """Every job is one stage: no task gathers, sorts or groups what others read."""
    monkeypatch.setattr(Q, "scratch", lambda s, name: str(tmp_path / name))
    spark.sparkContext.setJobGroup("survivors", "")
    try:
        found = C.survivors(Q._mutations(Tables(spark, SF))).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup("survivors")
    assert found and jobs and all(len(tracker.getJobInfo(j).stageIds) == 1 for j in jobs)


def test_readers_of_java_text_deal_files_to_all_tasks(spark):
    """A table in one split is still read by as many tasks as shuffles have."""
    files = spark.range(40, numPartitions=1).selectExpr("concat('F', id) AS file", "'class T { @Test void a() { x.go(); } }' AS body")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert read_code(files, ["file"], facts=("calls",)).rdd.getNumPartitions() == parts
    assert read_tests(files).rdd.getNumPartitions() == parts


def test_stack_lint_reads_texts_once_and_spreads_a_module(spark):
    """One Python step, and it gets only files that name the call; a module's files meet its stack in many parts."""
    files = spark.range(900, numPartitions=1).selectExpr("concat('F', id) AS file", "'m' AS module", "CASE id % 3 WHEN 0 THEN 'mockStatic(A.class);' WHEN 1 THEN '// mockStatic(' END AS body")
    imports = files.select("file", F.lit("org.junit.Test").alias("import")).union(files.select("file", F.lit("java.util.List")))
    profiles = spark.createDataFrame([("m", "junit5", "mockito", False, False)], "module string, test_framework string, mock_framework string, inline_mocks boolean, spring_test boolean")
    found = C.lint_stack(imports, files, profiles)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r.kind, r.subject): r["count"] for r in found.groupBy("kind", "subject").count().collect()} == {("JUNIT_VERSION_MISMATCH", "org.junit.Test"): 900, ("FEATURE_NOT_IN_STACK", "mockStatic"): 300}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_texts_are_told_in_pieces_of_bounded_bytes():
    batch = pa.RecordBatch.from_pydict({"file": ["a", "b", "c", "d"], "body": ["x" * SLICE_BYTES, None, "y" * SLICE_BYTES, "z"]})
    assert [b.column(0).to_pylist() for b in slices([batch], 1)] == [["a", "b"], ["c"], ["d"]]


def test_facts_of_a_test_body_are_those_of_its_text(spark):
    """The body's facts come with the body, from one scan; a body with an import line is read anew."""
    body = 'class T { /* @Test void no() {} */ @Test void a() {\n// given: x\nwhen(m.go()).then("}"); /* } */ // THEN\nimport x.y(1);\nb.c(2); } @Test void open() { // when\n f(3);'
    files = spark.createDataFrame([("A", body), ("B", None), ("C", "@Test void t() { a.b('{'); // given \n } // then")], "file string, body string")
    told, split = read_tests(files, facts=("calls", "notes")), read_tests(files)
    assert told.select(split.columns).collect() == split.collect() and split.count() == 3
    assert sorted(told.drop("body").collect()) == sorted(read_code(split, ["file", "pos", "name"], facts=("calls", "notes")).collect())
    plan = C.lint_methods(C.split_test_methods(files, C.METHOD_FACTS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_mutants_are_read_once_and_missing_names_are_equal(spark, tmp_path):
    survived = spark.createDataFrame([("r", "K", "m", 2, "x.MathMutator"), ("r", None, "m", 3, "x.Odd"), ("r", None, "m", 1, "x.Odd"), (None, "K", None, 1, None)], "repo string, fqcn string, method string, line int, mutator string")
    survived.write.parquet(f"{tmp_path}/mutants")
    found = C.mutant_priority(spark.read.parquet(f"{tmp_path}/mutants"))
    assert found.columns == ["repo", "fqcn", "method", "line", "mutator", "survivors", "hint", "priority"]
    assert {(r.repo, r.fqcn, r.line, r.survivors, r.priority) for r in found.collect()} == {("r", None, 1, 2, 1), ("r", None, 3, 2, 2), ("r", "K", 2, 1, 3), (None, "K", 1, 1, 1)}
    assert {r.hint for r in found.collect()} == {"arithmetic-operator-around-line-2", "behaviour-change-around-line-3", "behaviour-change-around-line-1"}
    assert not any("mutants" in f for f in found.inputFiles())  # what it returns reads its own table, not the reports anew


def test_coverage_reports_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<r><class name="a/B"><method name="m" desc="()V"><counter type="LINE" missed="1" covered="2"/></method><method name="n" desc="()I"/>'
        '<method name="o" desc="()J"><counter type="LINE" missed="3" covered="4"/></method><counter type="LINE" missed="5" covered="6"/></class>'
        '<class name="C"><counter type="LINE" missed="7" covered="8"/></class><class name="D"><method name="p" desc="()V"><counter type="LINE" missed="9" covered="0"/></method></class></r>'
    )
    found = I.read_coverage_xml(spark, str(tmp_path), "after")
    assert sorted((r.fqcn, r.method or "", r.method_pos, r.covered, r.missed) for r in found.collect()) == [
        ("C", "", -1, 8, 7), ("D", "p()V", 0, 0, 9), ("a.B", "", -1, 6, 5), ("a.B", "m()V", 0, 2, 1), ("a.B", "o()J", 2, 4, 3),
    ]
    assert found._jdf.queryExecution().executedPlan().toString().lower().count("scan xml") == 1


def block_files(spark):
    """Spark's own files on this machine: shuffles, for the most part."""
    tops = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {p: p.stat().st_size for top in tops for p in Path(top).rglob("*") if p.is_file()}


@pytest.fixture
def own_folder(spark, monkeypatch, tmp_path):
    """Tables are written to a folder of the test's own, and none is broadcast for its size."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    monkeypatch.setattr(lineage, "_shared_dir", lambda s: f"{tmp_path}/shared")
    yield tmp_path / "shared"
    spark.conf.set(name, before)


def test_packs_leave_less_than_four_inputs_on_disk(spark, own_folder):
    where = "/root/testdata/sf0.01"
    before = set(block_files(spark))
    catalog.load()[0]["j16_context_pack"](spark, where).write.format("noop").mode("overwrite").save()
    left = sum(n for p, n in block_files(spark).items() if p not in before) + sum(p.stat().st_size for p in own_folder.rglob("*") if p.is_file())
    assert left < 4 * sum(Path(where, f"{t}.parquet").stat().st_size for t in ("lineitem", "orders", "events", "part"))


def test_a_settled_table_leaves_no_shuffle_files(spark, own_folder):
    before, setting = set(block_files(spark)), spark.conf.get(lineage.RELEASE, None)
    found = lineage.settled(spark.range(9000).selectExpr("id % 900 AS k").groupBy("k").count())
    assert not [p for p in block_files(spark) if p not in before and p.name.startswith("shuffle_")]
    assert spark.conf.get(lineage.RELEASE, None) == setting
    assert found.count() == 900 and {r["count"] for r in found.collect()} == {10}


def ranked_by_class(rows):
    """The targets of each class by their ranks, worked out one repository at a time."""
    found = {}
    for repo in {r[0] for r in rows}:
        kept = []
        for _, target, sut, pos, lines, branches, _, penalty, boost in (r for r in rows if r[0] == repo):
            score = None if lines is None else 3 * lines + 5 * branches + (2 if lines or branches else 0) - penalty + boost
            if score is None and branches or score is not None and not (score <= 0 and lines == branches == 0):
                kept.append((score is None, -(score or 0), sut, pos, target))
        for rank, (_, _, sut, _, target) in enumerate(sorted(kept)):
            found.setdefault(sut, []).append((rank, target))
    return sorted((sut, ";".join(t for _, t in sorted(ranks))) for sut, ranks in found.items())


def test_targets_by_class_are_in_the_order_of_the_plan(spark, own_folder, monkeypatch):
    """Ranks are worked out only for a class in several repositories; a target without a score comes last."""
    rng = random.Random(5)
    rows = [(f"r{i % 3}", f"t{i}", f"c{i % 3}_{rng.randrange(4)}", rng.randrange(3), rng.choice((None, 0, 1, 2)), rng.randrange(2), "low", 0, rng.randrange(2)) for i in range(150)]
    mixed = [(*r[:2], "shared" if r[2].endswith("_0") else r[2], *r[3:]) for r in rows]
    schema = "repo string, target_id string, sut string, pos int, missed_lines long, missed_branches long, testability_risk string, penalty long, boost long"
    calls, plan = [], P.plan
    monkeypatch.setattr(P, "plan", lambda *a: calls.append(1) or plan(*a))
    for number, given in enumerate((rows, mixed)):
        found = P.plan_by_class(spark.createDataFrame(given, schema))
        assert sorted((r.sut, r.targets) for r in found.collect()) == ranked_by_class(given) and len(calls) == number


def test_dependencies_of_a_class_are_shuffled_once_and_looked_up(spark, own_folder, tmp_path):
    rng = random.Random(7)
    rows = [(f"s{rng.randrange(9)}", rng.choice((None, *"abcdefgh")), n) for n in range(200)] + [(None, "a", 1), ("lone", None, 1)]
    spark.createDataFrame(rows, "sut string, type string, pos int").write.parquet(f"{tmp_path}/deps")
    fixtures = [("a", "mock"), ("b", "builder"), ("b", "constructor"), ("c", None), ("d", "mock"), ("d", "builder"), ("e", "static"), ("z", "builder")]
    known = {"b": "builder", "d": "builder", "e": "static"}
    found = Y.class_supply(spark.read.parquet(f"{tmp_path}/deps"), spark.createDataFrame(fixtures, "fqcn string, strategy string"))
    want = {s: sorted({(t, known.get(t, "mock")) for x, t, _ in rows if x == s and t}) for s in {r[0] for r in rows} if s}
    assert {r.sut: [tuple(u) for u in r.uses] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("== Initial Plan ==")[0]
