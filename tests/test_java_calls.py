"""Calls read from Java text, and the verdicts on them."""

import pyarrow as pa
import pytest

from gapscan.functions.java_calls import LITERAL, Walk, read_calls, tokens
from gapscan.functions.java_code import read_code, slices
from gapscan.operators import symbols as Y


def uses(code):
    return [u[1:] for u in Walk(code).uses]


def test_tokens_know_comments_and_literals():
    code = "a /* x.y() */ . b ( \"q\\\"(\" , 'c' ) // z\n \"\"\"\n new T() \\\"\"\" \"\"\" -> 1.5f ..."
    assert tokens(code) == ["a", ".", "b", "(", LITERAL, ",", LITERAL, ")", LITERAL, "->", "1.5f", "..."]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("Foo f = null; f.go();", [("call", "Foo", "go", "f")]),
        ("{ Foo f; } f.go();", []),
        ("{ Foo f; f.a(); } { Bar f; f.b(); }", [("call", "Foo", "a", "f"), ("call", "Bar", "b", "f")]),
        ("class T { void m() { f.go(); this.f.up(); } Foo f; }", [("call", "Foo", "go", "f"), ("call", "Foo", "up", "f")]),
        ("class T { Foo f; void m(Bar f) { f.go(); } void n() { f.go(); } }", [("call", "Bar", "go", "f"), ("call", "Foo", "go", "f")]),
        ("class T { void m() { int f = 1; f.go(); } Foo f; }", []),
        ("for (Foo f : all) f.go(); f.no();", [("call", "Foo", "go", "f")]),
        ("run((Foo f, Bar b) -> { f.go(); b.up(); });", [("call", "Foo", "go", "f"), ("call", "Bar", "up", "b")]),
        ("try (Foo f = open()) { f.go(); } catch (OddError e) { e.getCause(); } e.no();", [("call", "Foo", "go", "f"), ("call", "OddError", "getCause", "e")]),
        ("if (o instanceof Foo f && f.ok()) { f.go(); }", [("call", "Foo", "ok", "f"), ("call", "Foo", "go", "f")]),
        ("var f = new Foo<String>(1); f.go(); var g = make(); g.go();", [("new", "Foo", None, None), ("call", "Foo", "go", "f")]),
        ("Map<String, List<Foo>> m; m.put(1); Foo[] a; a.clone(); Foo b[]; b.clone();", [("call", "Map", "put", "m")]),
        ("new a.b.Foo(); new Foo.Builder(); new Foo_Builder(); new Foo[3]; new int[2];", [("new", "a.b.Foo", None, None), ("builder", "Foo", None, None), ("generated", "Foo_Builder", None, None)]),
        ("Foo.go(); a.b.Foo.go(); Foo.MAX.go(); Foo.Bar.go(); a.b.go(); make().go();", [("static", "Foo", "go", None), ("static", "a.b.Foo", "go", None), ("static", "Foo.Bar", "go", None)]),
        ("Foo.Builder b = null; b.size(1).build();", [("call", "Foo", "size", "b")]),
        ("return foo; Foo::go; a < b; @Foo bar; case Foo: x.y();", []),
        ("} ) ( { < > new . class import", []),
    ],
)
def test_scopes(code, want):
    assert uses(code) == want


def test_package_and_imports():
    w = Walk("package a.b; import c.D; import static e.F.g; import h.*; class T {}")
    assert w.package == "a.b" and w.imports == ["c.D"]


def test_verdicts(spark):
    code = """package p; import q.Known; import r.Alien;
    class T { void a() throws Exception {
      new Known(); new java.util.ArrayList(); new Shut(); new Face(); new Known.Builder(); new Shut.Builder(); new Known_Builder();
      Known k = null; k.fine(); k.lost(); k.size(); k.getMessage(); k.build(); k.setter();
      Alien a = null; a.any(); Unknown u = null; u.any();
      OddException e = null; e.getMessage(); e.lost(); Known.fine(); Known.lost(); Mockito.lost(); Assertions.lost(); Nowhere.lost();
    } }"""
    files = spark.createDataFrame([("T.java", code), ("N.java", None)], "path string, content string")
    classes = spark.createDataFrame(
        [("q.Known", "class", False), ("p.Shut", "class", False), ("p.Face", "interface", False), ("z.OddException", "class", False), ("x.Mockito", "class", False)],
        "fqcn string, kind string, is_abstract boolean",
    )
    members = spark.createDataFrame(
        [("q.Known", "constructor", "<init>", "public", None), ("q.Known", "method", "fine", "public", None), ("q.Known", "builder", "setter", "public", "new Known.Builder()"),
         ("p.Shut", "constructor", "<init>", "private", None), ("p.Shut", "builder", "b", "public", "Shut.builder()"), ("p.Face", "constructor", "<init>", "public", None)],
        "fqcn string, kind string, name string, visibility string, entry string",
    ).selectExpr("*", "true AS usable")
    found = Y.lint_symbols(Y.extract_calls(files, classes), classes, members).orderBy("pos").collect()
    assert [(r.kind, r.type, r.method, r.fault) for r in found] == [
        ("new", "Shut", None, "INSTANTIATION_NOT_ALLOWED"), ("new", "Face", None, "INSTANTIATION_NOT_ALLOWED"), ("builder", "Shut", None, "BUILDER_NOT_VERIFIED"),
        ("generated", "Known_Builder", None, "DIRECT_GENERATED_BUILDER_FORBIDDEN"), ("call", "Known", "lost", "METHOD_NOT_IN_CONTRACT"), ("call", "Known", "getMessage", "METHOD_NOT_IN_CONTRACT"),
        ("call", "OddException", "lost", "METHOD_NOT_IN_CONTRACT"), ("static", "Known", "lost", "STATIC_METHOD_NOT_IN_CONTRACT"),
    ]
    assert read_calls(files).filter("file = 'N.java'").first().uses == []


def test_files_are_dealt_to_all_tasks(spark):
    """A table in one split is still read by as many tasks as shuffles have."""
    files = spark.range(400, numPartitions=1).selectExpr("concat('F', id, '.java') AS path", "'class T { void a(Foo x) { x.go(); } }' AS content")
    assert read_calls(files).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_asked_facts_are_told_in_short_pieces(spark):
    files = spark.range(1500, numPartitions=1).selectExpr("id AS file", "'class T { void a() { x.go(); } }' AS body")
    rows = read_code(files, ["file"], facts=("calls",))
    assert rows.columns == ["file", "calls"] and rows.filter("calls[0].name = 'a' AND calls[1].owner = 'x'").count() == 1500
    assert max(b.num_rows for b in slices([pa.RecordBatch.from_pydict({"x": list(range(1500))})])) == 512


def test_a_method_declares_no_field(spark):
    body = "class A { Foo f; void m() { Bar f = null; f.one(); record R(Baz z) { void n() { z.two(); } } } void o() { f.three(); } }"
    assert [(u[2], u[3]) for u in Walk(body).uses] == [("Bar", "one"), ("Baz", "two"), ("Foo", "three")]
