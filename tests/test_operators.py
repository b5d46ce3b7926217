"""Literal cases of the operators."""

import io
import random
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gapscan.config import Config
from gapscan.functions import scalars as S
from gapscan.operators import corpus as C
from gapscan.operators import delta as D
from gapscan.operators import gates as G
from gapscan.operators import graph as R
from gapscan.operators import planning as P
from gapscan.operators import symbols as Y
from gapscan.operators import telemetry as T
from gapscan.sources import ingest as I

TARGET = "repo string, target_id string, sut string, method string, pos int, missed_lines long, missed_branches long"


def targets(spark, rows):
    return spark.createDataFrame([("r", *r[:3], i, *r[3:]) for i, r in enumerate(rows)], TARGET)


def test_generated_classes_are_excluded(spark):
    rows = targets(spark, [("t1", "com.acme.openapi.model.ErrorData", "equals", 2, 10), ("t2", "com.acme.LogSanitizer", "sanitizeForLog", 5, 0)])
    rules = spark.createDataFrame([("package", "com.acme.openapi.model")], "rule_kind string, pattern string")
    for boundary in (False, True):
        assert [r.target_id for r in P.exclude_generated(rows, rules, boundary=boundary).collect()] == ["t2"]
    none = rules.limit(0)
    assert P.exclude_generated(rows, none).count() == P.exclude_generated(rows, none, boundary=True).count() == 2
    near = spark.createDataFrame([("package", "com.acme.Log")], "rule_kind string, pattern string")
    assert P.exclude_generated(rows, near).count() == 1 and P.exclude_generated(rows, near, boundary=True).count() == 2


def test_many_package_rules_against_plain_matching(spark):
    import re

    rng = random.Random(6)
    names = [".".join(rng.choice(["com", "org", "acme", "gen", "a[0]"]) for _ in range(rng.randrange(1, 5))) + rng.choice(["", ".Foo", ".FooBar", ".X$1"]) for _ in range(80)]
    patterns = ["com.acme", "com.acme.gen.*", "org.*.Foo", "*X$1", "a[0].c", "com.*acme*Bar", "gen.Foo", "org.acme.", "zz.*"] + [f"pkg{i}.*" for i in range(2000)]
    df = targets(spark, [(f"t{i}", n, "m", 1, 1) for i, n in enumerate(names)])
    rules = spark.createDataFrame([("package", p) for p in patterns] + [("fqcn", "com.org.Foo")], "rule_kind string, pattern string")
    kept = P.exclude_generated(df, rules)
    plain = [re.compile(".*".join(map(re.escape, p.split("*")))) for p in patterns]
    assert sorted(r.sut for r in kept.collect()) == sorted(n for n in names if n != "com.org.Foo" and not any(p.match(n) for p in plain))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert P.exclude_generated(df, rules.limit(0)).count() == len(names)


def test_lambdas_go_to_their_parent(spark):
    rows = targets(spark, [("lambda-target", "com.acme.Q", "lambda$requireConfiguredCluster$0()L;", 3, 2), ("parent-target", "com.acme.Q", "requireConfiguredCluster()L;", 1, 0)])
    (r,) = P.collapse_lambdas(rows).collect()
    assert (r.target_id, r.missed_lines, r.missed_branches, r.collapsed, r.fallback) == ("parent-target", 4, 2, "lambda-target", False)
    (r,) = P.collapse_lambdas(targets(spark, [("only", "com.acme.S", "lambda$getCurrentStatus$1()L;", 3, 0)])).collect()
    assert (r.method, r.fallback) == ("getCurrentStatus()", True)


def test_plan_limits(spark):
    rows = targets(spark, [(f"t{i:03d}", f"com.acme.Svc{i:04d}", "m()", 3 + i % 5, i % 3) for i in range(105)])
    rich = rows.withColumn("testability_risk", F.lit("low")).withColumn("penalty", F.lit(0)).withColumn("boost", F.lit(0))
    all_ = [r.target_id for r in P.plan(rich).orderBy("plan_rank").collect()]
    first = P.plan(rich, 50).orderBy("plan_rank").collect()
    assert len(all_) == 105 and [r.target_id for r in first] == all_[:50] and {r.eligible for r in first} == {105}
    covered = targets(spark, [("a", "x.A", "m", 0, 0), ("b", "x.B", "m", 0, 1)]).withColumn("plan_score", F.lit(0))
    assert [r.target_id for r in P.drop_covered(covered).collect()] == ["b"]


def streaks(spark, cycles):
    df = spark.createDataFrame([("r", i, a, a, False) for i, a in enumerate(cycles)], "run_id string, cycle long, lines_delta long, branches_delta long, compile_failed boolean")
    return [r.stall_streak for r in T.stall_streak(df).orderBy("cycle").collect()]


def test_stall_counts_only_measured_flat_cycles(spark):
    assert streaks(spark, [0, 0, 5, 0, None, 0]) == [1, 2, 0, 1, 1, 2]
    assert streaks(spark, [None, None]) == [0, 0]


def test_costs(spark):
    rows = [("run", "a", "generation", 1, 1000, 500, "x/opus-4", False, 0), ("run", "b", "repair", 1, 200, 100, "SONNET", False, 0)]
    df = spark.createDataFrame(rows, "run_id string, target_id string, role string, round long, tokens_in long, tokens_out long, model string, estimated boolean, duration_ms long")
    total = T.cost_rollup(T.with_cost(df, T.price_table(spark))).filter("role IS NULL").first()
    assert (total.tokens_in, total.tokens_out, total.source) == (1200, 600, "api_usage") and total.cost_usd == pytest.approx(0.0525 + 0.0021)
    free = T.with_cost(df, T.price_table(spark, {"opus": (0, 0)}))
    assert free.filter("role = 'generation'").first().cost_usd == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5000), st.lists(st.integers(0, 50), min_size=1, max_size=6)), min_size=1, max_size=4))
def test_distribute_never_loses_a_unit(spark, groups):
    rows = [(g, i, total, w) for g, (total, ws) in enumerate(groups) for i, w in enumerate(ws)]
    out = T.distribute(spark.createDataFrame(rows, "g long, i long, total long, weight long"), ["g"], ["i"])
    sums = {r.g: r.s for r in out.groupBy("g").agg(F.sum("share").alias("s")).collect()}
    for g, (total, ws) in enumerate(groups):
        # rounding up each of the others can pass the total by less than a unit an item
        assert 0 <= sums[g] - total < len(ws)


def test_pauses_do_not_count(spark):
    def over(rows):
        df = spark.createDataFrame([("r", i, s, k) for i, (s, k) in enumerate(rows)], "run_id string, seq long, sec long, kind string")
        return [(r.active_seconds, r.over_budget) for r in T.elapsed_active(df).orderBy("seq").collect()]

    assert over([(0, "tick"), (100, "pause"), (5000, "resume"), (5100, "tick")])[-1] == (200, False)
    assert over([(0, "tick"), (700, "pause"), (5000, "tick")])[-1] == (700, True)
    assert over([(0, "tick"), (50, "resume"), (60, "pause"), (70, "pause"), (90, "resume"), (100, "tick")])[-1] == (70, False)


def test_evidence_gate(spark):
    known = spark.createDataFrame([("ctor:1",), ("m:2",)], "evidence_id string")
    rows = [("pass", "OK", "a", ["ctor:1"]), ("none", "OK", "b", []), ("orphan", "OK", "c", ["m:2", "x:9"]), ("blocked", "BLOCKED", "d", ["x:9"]), ("thrown", "OK", "e", ["inherited:getMessage"])]
    df = spark.createDataFrame(rows, "patch_id string, status string, method string, evidence_ids array<string>")
    assert {r.patch_id: r.verdict for r in G.gate_evidence(df, known).collect()} == {"pass": "PASS", "none": "FAIL", "orphan": "FAIL", "blocked": "SKIPPED", "thrown": "PASS"}


def test_each_request_has_one_outcome(spark):
    requests = spark.createDataFrame([("b", f"t{i}", i) for i in range(6)], "batch_id string, target_id string, pos long")
    answers = [("t0", "generated", 2), ("t1", "generated", 0), ("t2", "skipped", 0), ("t3", "need-more-context", 0), ("t4", "weird", 1), ("t0", "generated", 1), ("t9", "generated", 1)]
    responses = spark.createDataFrame([("b", t, i, s, n) for i, (t, s, n) in enumerate(answers)], "batch_id string, target_id string, pos long, status string, n_methods long")
    got = {(r.target_id, r.nth): r.outcome for r in G.reconcile(requests, responses).collect()}
    assert got == {("t0", 1): "valid", ("t0", 2): "duplicated", ("t1", 1): "invalid-no-methods", ("t2", 1): "skipped", ("t3", 1): "need-more-context",
                   ("t4", 1): "invalid-status", ("t5", 0): "omitted", ("t9", 1): "unknown"}


def test_architecture_rules(spark):
    files = [("r", "src/controller/A.java", "import x.repository.OrderRepository;"), ("r", "app.properties", "db.password=supersecret"), ("r", "src/service/B.java", "import x.controller.C;")]
    got = {(r.severity, r.category) for r in C.architecture_findings(spark.createDataFrame(files, "repo string, path string, content string")).collect()}
    assert {("HIGH", "layering"), ("CRITICAL", "security"), ("MEDIUM", "layering"), ("INFO", "observability")} <= got


def test_build_logs_of_every_format(spark):
    logs = {
        "maven": ["[ERROR] /C:/x/F.java:[12,5] package a.b does not exist"],
        "jdt": ["1. ERROR in /x/F.java (at line 7)", "\tfoo.bar();", "\t^^^", "\tTypo();", "\tType mismatch: cannot convert from int to String", "----------", "\tlater"],
        "vscode": ["src/F.java(3, 9): error: method does not override"],
    }
    lines = spark.createDataFrame([(k, i, x) for k, v in logs.items() for i, x in enumerate(v)], "run_id string, line_no int, line string")
    got = {r.run_id: (r.format, r.file, r.line, r.code) for r in C.parse_build_errors(lines).collect()}
    assert got == {"maven": ("maven", "/C:/x/F.java", 12, "E_PACKAGE_UNRESOLVED"), "jdt": ("jdt", "/x/F.java", 7, "E_TYPE_MISMATCH"), "vscode": ("vscode", "src/F.java", 3, "E_OVERRIDE")}


def test_impact_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "fqcn string")
    assert {r.node: r.hops for r in R.impact(seeds, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node for r in R.impact(seeds, edges, Config(impact_depth=9)).collect()} == set("abcdef")
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("y", "y")], "src string, dst string")
    assert {tuple(r) for r in R.fixture_cycles(loop).collect()} == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("y", "y", 1)}


def test_classes_by_precedence(spark):
    rows = [("x.Forest", "class", False, []), ("x.A", "interface", False, ["Service"]), ("x.B", "interface", False, []), ("x.C", "record", False, []), ("x.GenDto", "class", False, ["Service"]), ("x.Zed", "class", False, [])]
    df = spark.createDataFrame(rows, "fqcn string, kind string, is_abstract boolean, annotations array<string>")
    got = {r.fqcn: r.type for r in Y.classify_classes(df, spark.createDataFrame([("x.GenDto",)], "fqcn string")).collect()}
    assert got == {"x.Forest": "controller", "x.A": "service", "x.B": "non-instantiable", "x.C": "data-carrier", "x.GenDto": "generated", "x.Zed": "component"}


def test_imports_survive_compaction(spark):
    rows = [("c", i, n) for i, n in enumerate(["a.b.X", "a.b.Y", "a.b.Z", "q.W", "q.V"])]
    df = spark.createDataFrame(rows, "fqcn string, pos int, import string")
    compact = Y.compact_imports(df)
    assert {r.prefix: r.leaves for r in compact.collect()} == {"a.b": "X,Y,Z", "_": "q.W,q.V"}
    assert sorted(r["import"] for r in Y.expand_imports(compact).collect()) == sorted(n for _, _, n in rows)


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(S.namespace_to_package(F.lit("http://www.Shop.example:80/a-b/2/"))) == "example.shop.a_b._2"
    assert value(S.decode_descriptor(F.lit("(Ljava/lang/String;[I)V"))) == (["java.lang.String", "int[]"], "void")
    assert value(S.extract_usage(F.lit('{"usage":{"input_tokens":1000,"output_tokens":300}}'))) == (1000, 300)
    assert value(S.extract_usage(F.lit('{"prompt_tokens":"7"}'))) == (7, 0) and value(S.extract_usage(F.lit("{}"))) is None
    assert value(S.exception_code(F.lit("a.MyAssertionError"))) == "E_ASSERTION"
    assert value(S.package_of(F.lit("NoPackage"))) == "" and value(S.camel(F.lit("a.List<b.C>"))) == "list"


def test_archives_rules_and_state(spark, tmp_path):
    for name, entries in {"a.zip": {"top/src/A.java": "class A {}", "top/b.bin": "x"}, "b.jar": {"p/q/C.class": "", "p/q/C$D.class": "", "E.class": ""}}.items():
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for k, v in entries.items():
                z.writestr(k, v)
        (tmp_path / name).write_bytes(buffer.getvalue())
    got = I.read_source_archives(spark, str(tmp_path / "a.zip")).collect()
    assert [(r.path, r.kind, r.content) for r in got] == [("src/A.java", "java", "class A {}")]
    jar = I.read_archive_entries(spark, str(tmp_path / "b.jar")).collect()
    assert {(r.level, r.name) for r in jar} == {("class", "p.q.C"), ("class", "E"), ("package", "p.q")}
    rules = tmp_path / "rules"
    rules.mkdir()
    (rules / "b.rules").write_text('# no\n"cannot find (.*)" => addImport($1)\nbroken\n')
    (rules / "a.rules").write_text('"x" => escalateToLLM()\n')
    assert [(r.rule_order, r.file, r.line, r.action, r.evidence_required) for r in I.read_rules(spark, str(rules)).orderBy("rule_order").collect()] == [
        (1, "a.rules", 1, "escalateToLLM", False), (2, "b.rules", 2, "addImport", True)]
    state = tmp_path / "state"
    state.mkdir()
    (state / "1.json").write_text('{"id": 1,\n "kind": "x"}')
    (state / "2.json").write_text('{"id": ')
    good, bad = I.read_state_json(spark, str(state), "id long, kind string")
    assert [(r.id, r.kind) for r in good.collect()] == [(1, "x")] and len(bad.collect()) == 1
    src = tmp_path / "src"
    src.mkdir()
    (src / "OrderController.java").write_text("class X {}")
    (src / "x.bin").write_text("no")
    assert [(r.kind, r.size) for r in I.read_sources(spark, str(src)).collect()] == [("java-controller", 10)]


def test_delta_totals_are_sums(spark):
    rows = [("r", s, f"c{i}", i * k, i) for i in range(5) for s, k in (("before", 1), ("after", 2)) if (i, s) != (3, "before")]
    delta = D.coverage_delta(spark.createDataFrame(rows, "repo string, snapshot string, fqcn string, covered_lines long, covered_branches long"))
    total = D.coverage_totals(delta).first()
    assert total.lines_delta == sum(r.lines_delta for r in delta.collect()) == 20 - 7


def test_context_pack_against_brute_force(spark):
    from gapscan.operators.symbols import context_pack

    plan = [("a", "t2", 2), ("a", "t1", 1), ("b", "t3", 3)]
    deps, fixtures = [("a", "X", 1), ("a", "X", 2), ("a", "W", 3), ("c", "X", 1)], [("X", "f1", "builder")]
    members, digest = [("a", 1, "method", "go"), ("a", 0, "constructor", "<init>")], [("a", 1, "E", "F")]
    make = spark.createDataFrame
    rows = context_pack(
        make(plan, "sut string, target_id string, plan_rank int"), make([("a", "service", "t.java")], "fqcn string, type string, template string"),
        make([("a", 3), ("a", 4)], "fqcn string, covered_lines long"), make(members, "fqcn string, pos int, kind string, name string"),
        make(deps, "sut string, type string, pos int"), make(fixtures, "fqcn string, fixture_id string, strategy string"),
        make([("a", "i,j")], "fqcn string, imports string"), make(digest, "sut string, place int, error_code string, fix_id string"),
    ).collect()
    want = {}
    for s in {p[0] for p in plan}:
        built = dict((f, k) for f, _, k in fixtures)
        want[s] = (
            ";".join(t for _, t in sorted((n, t) for x, t, n in plan if x == s)),
            ";".join(f"{k}:{n}" for _, k, n in sorted((p, k, n) for x, p, k, n in members if x == s)),
            ";".join(f"{t}:{built.get(t, 'mock')}" for t in sorted({t for x, t, _ in deps if x == s})),
            ";".join(f"{e}:{f}" for x, _, e, f in digest if x == s),
        )
    assert {r.sut: (r.targets, r.members, r.dependencies, r.failures) for r in rows} == want and len(rows) == 2
    assert {r.sut: (r.type, r.covered_lines, r.imports) for r in rows} == {"a": ("service", 7, "i,j"), "b": (None, None, "")}


def test_stack_rules_of_unknown_modules_and_comments(spark):
    files = spark.createDataFrame([("a", "m", "mockStatic(X.class)"), ("b", "none", "// mockStatic(X.class)"), ("c", "m", None)], "file string, module string, body string")
    imports = spark.createDataFrame([("a", "org.junit.Before"), ("b", "org.mockito.Mock"), ("b", "org.junit.Before"), ("c", None)], "file string, import string")
    profiles = spark.createDataFrame([("m", "junit5", "mockito", False, False)], "module string, test_framework string, mock_framework string, inline_mocks boolean, spring_test boolean")
    got = {tuple(r) for r in C.lint_stack(imports, files, profiles).collect()}
    assert got == {("a", "JUNIT_VERSION_MISMATCH", "org.junit.Before"), ("a", "FEATURE_NOT_IN_STACK", "mockStatic"), ("b", "FRAMEWORK_NOT_IN_STACK", "org.mockito.Mock")}


def test_type_caps_move_rows_on_and_lose_none(spark):
    rows = [("r", i, f"t{i}", "a" if i % 3 else None) for i in range(1, 20)]
    planned = spark.createDataFrame(rows, "repo string, plan_rank int, target_id string, type string")
    got = P.batches(planned, 4, type_caps={"a": 2}).collect()
    assert sorted(r.target_id for r in got) == sorted(r[2] for r in rows)
    for batch in {r.batch_id for r in got}:
        held = [r.type for r in got if r.batch_id == batch]
        assert len(held) <= 4 and held.count("a") <= 2


def test_numbers_of_a_class_do_not_depend_on_chunks(spark):
    rows = [("r", i * 1000, f"c{i % 2}", f"t{i}") for i in range(1, 30)]
    planned = spark.createDataFrame(rows, "repo string, plan_rank int, sut string, target_id string")
    got = {r.target_id: r.batch_id for r in P.batches(planned, 2, one_class_a_batch=True).collect()}
    assert got == {f"t{i}": f"batch-{(i + 1) // 2:03d}" for i in range(1, 30)}


def test_every_planned_class_has_a_pack(spark):
    from gapscan.plans import catalog

    queries, where = catalog.load()[0], "/root/testdata/sf0.001"
    planned = sorted((r.sut, r.target_id) for r in queries["w02_plan"](spark, where).select("sut", "target_id").collect())
    packs = queries["j16_context_pack"](spark, where).select("sut", "targets", "dependencies").collect()
    assert sorted((r.sut, t) for r in packs for t in r.targets.split(";")) == planned
    # every line's supplier is a dependency of the line's part
    lines = {(r.l_partkey, r.l_suppkey) for r in spark.read.parquet(f"{where}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    number = lambda name: int(__import__("re").search(r"\.C(\d+)", name)[1])
    for r in packs:
        got = {number(d) for d in r.dependencies.split(";") if d}
        assert got == {s for p, s in lines if p == number(r.sut)}


def test_cycle_partners_lists_the_whole_group(spark):
    loop = spark.createDataFrame([("b", "a"), ("a", "c"), ("c", "b"), ("c", "x"), ("x", "p"), ("p", "x"), ("y", "y")], "src string, dst string")
    got = {tuple(r) for r in R.cycle_partners(R.fixture_cycles(loop)).collect()}
    assert got == {("a", "b,c", "a", 3), ("b", "a,c", "a", 3), ("c", "a,b", "a", 3), ("x", "p", "p", 2), ("p", "x", "p", 2), ("y", "", "y", 1)}


def plain_groups(edges):
    """Strongly connected groups of two or more, by what each node reaches."""
    out = {}
    for u, v in edges:
        out.setdefault(u, set()).add(v)

    def reached(u):
        seen, todo = set(), [u]
        while todo:
            for v in out.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen

    reach = {u: reached(u) for u in out}
    groups = {u: sorted({v for v in reach[u] if u in reach.get(v, ())} | {u}) for u in reach}
    return {(u, g[0], len(g)) for u, g in groups.items() if len(g) > 1}


@pytest.mark.parametrize("seed", [1, 3])
def test_strong_groups_against_reachability(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(40)]
    edges = [tuple(rng.sample(names, 2)) for _ in range((30, 45, 60, 90)[seed])] + [("a1", "a2"), ("a2", "a1"), ("a2", "n00"), ("z", "z")]
    got = {tuple(r) for r in R.strong_groups(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == plain_groups(edges)


def test_long_rings_and_chains_settle_by_doubling(spark, monkeypatch):
    """A ring of 300 nodes with a chain as long into it and one out of it: steps go by the
    logarithm of its length (hop by hop they would be 300 and more)."""
    n, steps = 300, []
    keep = R.written
    monkeypatch.setattr(R, "written", lambda df: steps.append(1) or keep(df))
    ring = [(f"r{i:05d}", f"r{(i + 1) % n:05d}") for i in range(n)]
    chains = [(f"in{i:05d}", f"in{i + 1:05d}" if i < n - 1 else ring[7][0]) for i in range(n)] + [(ring[9][0] if i == 0 else f"out{i:05d}", f"out{i + 1:05d}") for i in range(n)]
    rows = R.strong_groups(spark.createDataFrame(ring + chains, "src string, dst string")).collect()
    assert len(rows) == n and {tuple(r)[1:] for r in rows} == {("r00000", n)} and len(steps) <= 12 * n.bit_length()


def test_colours_find_dense_groups(spark):
    rng = random.Random(9)
    edges = [(f"{g}{rng.randrange(25):02d}", f"{g}{rng.randrange(25):02d}") for g in "ab" for _ in range(120)] + [("a01", "b01")]
    edges = [e for e in edges if e[0] != e[1]]
    found = R._coloured(spark.createDataFrame(edges, "src string, dst string").distinct(), 40)
    assert found is not None
    sizes = found[0].groupBy("label").count().filter("count > 1").collect()
    assert {(r.label, r["count"]) for r in sizes} <= {(g, k) for _, g, k in plain_groups(edges)}
    assert R._coloured(spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "src string, dst string"), 3) is None


def test_framework_imports_go_by_simple_name(spark):
    bodies = {
        "hamcrest": "assertThat(x, is(1));", "bare": "when(a.b()).thenReturn(1);", "wild": "when(a); verify(b);", "type": "ArgumentCaptor<A> c; Assertions.fail();",
        "noise": '// when(x)\nString s = "verify(x)"; a.fail();', "own": "Mockito.mock(A.class);",
    }
    imports = [("hamcrest", "org.hamcrest.MatcherAssert.assertThat", True), ("wild", "org.mockito.Mockito.*", True), ("type", "org.mockito.Mockito.*", True), ("own", "org.mockito.Mockito", False)]
    got = G.missing_framework_imports(spark.createDataFrame(list(bodies.items()), "file string, body string"), spark.createDataFrame(imports, "file string, import string, is_static boolean"))
    assert sorted(map(tuple, got.collect())) == [("bare", "static", "when"), ("type", "type", "ArgumentCaptor"), ("type", "type", "Assertions")]


def test_doubles_of_the_class_under_test(spark):
    bodies = {
        "plain": "@Mock Foo foo;", "modifier": "@Mock private Foo foo;", "arguments": "@MockBean(name = \"x\")\n  @Lazy private final Foo foo;", "call": "Foo f = mock( Foo.class );",
        "other": "@Mock private Bar bar; Foo foo;", "commented": "// @Mock Foo foo;\n",
    }
    files = spark.createDataFrame([(k, v, "Foo") for k, v in bodies.items()], "file string, body string, sut string")
    assert {r.file for r in C.lint_tests(files).filter("kind = 'MOCKS_SUT'").collect()} == {"plain", "modifier", "arguments", "call"}


def test_stubs_that_nothing_calls(spark):
    bodies = {
        "unused": "when(a.b()).thenReturn(1); sut.run();", "used": "when(a.b()).thenReturn(1); assertEquals(1, a.b());", "bdd": "given(a . b(x)).willReturn(1);",
        "after": "doReturn(1).when(a).b(); sut.run();", "twice": "doReturn(1).when(a).b(); a.b(); a.b();", "none": "sut.run();",
    }
    methods = spark.createDataFrame([(k, 0, "shouldRun_whenAsked", v) for k, v in bodies.items()], "file string, pos int, name string, body string")
    assert {r.file for r in C.lint_methods(methods).filter("kind = 'UNUSED_STUB'").collect()} == {"unused", "bdd", "after"}


def test_noise_is_read_once_from_left_to_right(spark):
    texts = ['a = "x // y"; b', "c // \"d\ne", "f/* ' */g", "'\"' + h", '"\\"" + i', "  import j.K;\nl"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.strip_noise(F.col("t")).alias("x")).collect()]
    assert got == ['a = ""; b', "c \ne", "f g", "'' + h", '"" + i', "\nl"]


def test_batch_size_follows_the_cycles_before(spark):
    rows = [(1, 0.0, 3, False), (2, 0.0, 2, False), (3, 0.4, 1, False), (4, 0.0, 1, False), (5, 0.0, 1, False), (6, 0.0, 0, True), (7, 0.0, 1, False)]
    cycles = spark.createDataFrame([("r", *x) for x in rows], "run_id string, cycle int, fail_rate double, delta int, slow boolean")
    assert [r.batch_size for r in T.dynamic_batch_size(cycles).orderBy("cycle").collect()] == [5, 5, 7, 2, 5, 3, 5]
    assert [r.batch_size for r in T.dynamic_batch_size(cycles, base=9).orderBy("cycle").collect()] == [9, 9, 10, 4, 9, 3, 9]


def test_fixture_strategies(spark):
    members = [
        ("a.B", 0, "builder", "x", "public", 0, "e0", "B_Builder()", None, False, None), ("a.B", 1, "constructor", "<init>", "public", 1, "e1", None, None, False, None),
        ("a.C", 0, "builder", "x", "public", 0, "e2", "C.Builder()", "make()", False, None), ("a.D", 0, "method", "of", "package", 1, "e3", None, None, True, "D"),
        ("a.E", 0, "method", "of", "public", 1, "e4", None, None, True, "int"), ("a.I", 0, "method", "of", "public", 0, "e5", None, None, True, "a.I"),
        ("a.I", 1, "builder", "x", "public", 0, "e6", "I.Builder()", None, False, None),
    ]
    kinds = "fqcn string, pos int, kind string, name string, visibility string, n_params int, evidence_id string, entry string, build string, is_static boolean, return_type string"
    classes = spark.createDataFrame([(f"a.{x}", "interface" if x == "I" else "class", x == "A") for x in "ABCDEI"], "fqcn string, kind string, is_abstract boolean")
    got = {r.fqcn[-1]: (r.strategy, r.evidence, r.degraded) for r in Y.build_fixtures(spark.createDataFrame(members, kinds), classes).collect()}
    assert got == {"A": ("mock", None, False), "B": ("constructor", "e1", False), "C": ("builder", "C.Builder() … make()", False), "D": ("factory", "e3", False), "E": ("mock", None, True), "I": ("mock", None, False)}
    assert {r.degraded for r in Y.build_fixtures(spark.createDataFrame(members, kinds), classes, with_mocks=False).filter("strategy = 'mock'").collect()} == {True}


def test_indented_trace_with_a_lower_case_test_class(spark):
    text = ["  Caused by: x.BadException: why: so", "\tat org.junit.R.go(R.java:1)", "\tat a.Foo$In.<init>(Foo.java:3)", "\tat a.Mytests1.run(M.java)", "\tat a.B.c(Native Method)"]
    got = C.parse_stack_traces(spark.createDataFrame([("t", i, x) for i, x in enumerate(text)], "trace_id string, line_no int, line string")).first()
    assert (got.exception, got.message, got.relevant_frame, got.symbol, got.test_frame) == ("x.BadException", "why: so", "a.Foo$In.<init>:3", "a.Foo$In#<init>", "a.Mytests1.run")


def test_calls_on_any_variable_of_the_class(spark):
    bodies = {"renamed": "final Foo x = make(); x . leap();", "full": "a.Foo<T> y; y.leap();", "fine": "Foo x = make(); x.run(); other.leap();", "undeclared": "foo.leap();", "named": "FooBar z = q; z.leap();"}
    row = lambda b: (1, "patch:1", "a.Foo", "a.Foo", "a.FooTest", ["a.B"], ["a.B"], ["B"], ["e"], ["e"], [], b, ["run"])
    kinds = "k string, schema_version int, patch_id string, sut string, request_sut string, test_class string, imports array<string>, allowed_imports array<string>, annotations array<string>, evidence_ids array<string>, allowed_ids array<string>, required_ids array<string>, body string, evidenced_methods array<string>"
    got = {r.k: r.reason for r in G.validate_patch_methods(spark.createDataFrame([(k, *row(b)) for k, b in bodies.items()], kinds)).collect()}
    assert got == {"renamed": "CALL_WITHOUT_EVIDENCE", "full": "CALL_WITHOUT_EVIDENCE", "fine": None, "undeclared": None, "named": None}
