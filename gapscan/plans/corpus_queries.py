"""Raw corpora: formats that Spark writes from the tables and reads back, logs, lint,
findings and profiles."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import corpus as C
from ..sources import ingest as I
from ..sources import tables as B
from .adapters import scratch
from .catalog import CATALOG

add = CATALOG.add


def _written(t, lines, name):
    path = scratch(t.spark, name)
    lines.write.text(path)
    return path


def _written_xml(t, rows, tag, name, rows_a_file=50_000):
    """Rows as elements of documents with a root, one document a file of bounded length, by
    Spark's own writer: nothing is shuffled or gathered for it."""
    path = scratch(t.spark, name)
    rows.write.format("xml").options(rootTag="root", rowTag=tag, declaration="", maxRecordsPerFile=rows_a_file).save(path)
    return path


def _coverage_xml(t):
    counter = lambda kind, missed: F.struct(F.lit(kind).alias("_type"), missed.alias("_missed"), F.lit(3).alias("_covered"))
    # numbers are gathered; what is the same in every method is put around them afterwards
    rows = t("targets").groupBy("sut").agg(F.sort_array(F.collect_list(F.struct("pos", "missed_lines", "missed_branches"))).alias("ms"), F.sum("missed_lines").alias("n"))
    method = lambda m: F.struct(F.concat(F.lit("m"), m["pos"].cast("string")).alias("_name"), F.lit("()V").alias("_desc"), F.lit(1).alias("_line"), F.array(counter("LINE", m["missed_lines"]), counter("BRANCH", m["missed_branches"])).alias("counter"))
    text = rows.select(F.regexp_replace("sut", r"\.", "/").alias("_name"), F.lit("X.java").alias("_sourcefilename"), F.transform("ms", method).alias("method"), F.array(counter("LINE", F.col("n"))).alias("counter"))
    return _written_xml(t, text, "class", "coverage")


add(
    "s01_read_coverage_xml", lambda t: I.read_coverage_xml(t.spark, _coverage_xml(t), "after").drop("file", "method_pos"),
    """SELECT 'after' AS snapshot, sut AS fqcn, 'm' || CAST(pos AS STRING) || '()V' AS method, 'LINE' AS counter, CAST(3 AS BIGINT) AS covered, missed_lines AS missed FROM targets
       UNION ALL SELECT 'after', sut, 'm' || CAST(pos AS STRING) || '()V', 'BRANCH', 3, missed_branches FROM targets
       UNION ALL SELECT 'after', sut, NULL, 'LINE', 3, CAST(SUM(missed_lines) AS BIGINT) FROM targets GROUP BY sut""",
)
_MUT = ("Survived", "KILLED", "NO_COVERAGE")


def _mutations(t):
    text = t("lineitem").select(
        F.element_at(F.array(*[F.lit(x) for x in _MUT]), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("_status"), F.concat(F.lit("com.K"), F.col("l_partkey") % 40).alias("mutatedClass"),
        F.concat(F.lit("m"), "l_linenumber").alias("mutatedMethod"), F.lit("()V").alias("methodDescription"), F.when(F.col("l_partkey") % 50 == 0, "odd").otherwise((F.col("l_orderkey") % 90).cast("string")).alias("lineNumber"),
        F.concat(F.lit("x.y."), F.when(F.col("l_partkey") % 2 == 0, "MathMutator").otherwise("Strange")).alias("mutator"), F.lit("d").alias("description"),
    )
    return I.read_mutations_xml(t.spark, _written_xml(t, text, "mutation", "mutations")).drop("file")


_MUT_SQL = """mut AS (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'SURVIVED' WHEN 1 THEN 'KILLED' ELSE 'NO_COVERAGE' END AS status, 'com.K' || CAST(l_partkey % 40 AS STRING) AS fqcn, 'm' || CAST(l_linenumber AS STRING) || '()V' AS method,
    CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE CAST(l_orderkey % 90 AS INTEGER) END AS line, CASE WHEN l_partkey % 2 = 0 THEN 'x.y.MathMutator' ELSE 'x.y.Strange' END AS mutator, 'd' AS description FROM lineitem)"""
add("s02_read_mutations_xml", _mutations, f"WITH {_MUT_SQL} SELECT * FROM mut")
add("f06_survivors", lambda t: C.survivors(_mutations(t)), f"WITH {_MUT_SQL} SELECT * FROM mut WHERE status = 'SURVIVED'")
add(
    "a04_mutant_priority", lambda t: C.mutant_priority(C.survivors(_mutations(t)).withColumn("repo", F.lit("r"))),
    f"""WITH {_MUT_SQL}, s AS (SELECT *, 'r' AS repo, count(*) OVER (PARTITION BY fqcn, method) AS survivors,
            CASE mutator WHEN 'x.y.MathMutator' THEN 'arithmetic-operator' ELSE 'behaviour-change' END || '-around-line-' || CAST(line AS STRING) AS hint FROM mut WHERE status = 'SURVIVED')
        SELECT *, CAST(row_number() OVER (ORDER BY survivors DESC, fqcn, method, line, mutator) AS INTEGER) AS priority FROM s""",
)
add(
    "s03_latest_report",
    lambda t: I.latest_report(t("orders").select(F.concat(F.lit("/m/mod"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("/r.xml")).alias("file"), "o_orderkey")).select("module", "o_orderkey"),
    """WITH o AS (SELECT 'mod' || CAST(o_custkey % 50 AS STRING) AS module, strftime(o_orderdate, '%Y%m%d') AS d, o_orderkey FROM orders)
       SELECT module, o_orderkey FROM o QUALIFY d = max(d) OVER (PARTITION BY module)""",
)


def _reports(t):
    bad = lambda k, n: F.when(F.col("class_no") % k == 0, n).otherwise(0)
    text = t("classes").filter("class_no % 3 > 0").select(F.col("fqcn").alias("_name"), bad(5, 1).alias("_failures"), bad(7, 2).alias("_errors"), F.lit(3).alias("_tests"))
    path = _written_xml(t, text, "testsuite", "reports")
    return I.read_test_reports(t.spark, path, t("classes").select(F.col("fqcn").alias("test_class")))


add(
    "s04_read_test_reports", _reports,
    "SELECT fqcn AS test_class, CASE WHEN class_no % 3 = 0 THEN NULL WHEN class_no % 5 = 0 OR class_no % 7 = 0 THEN 'failed' ELSE 'passed' END AS result FROM classes",
)


def _poms(t):
    dep = lambda g, a, v: F.struct(F.lit(g).alias("groupId"), F.lit(a).alias("artifactId"), F.lit(v).alias("version"))
    every = lambda k: F.col("p_size") % k == 0
    named = lambda x: F.struct(F.lit(x).alias("artifactId"))
    text = t("part").select(
        F.lit("http://maven.apache.org/POM/4.0.0").alias("_xmlns"), F.concat(F.lit("a"), "p_partkey").alias("artifactId"), F.when(every(3), named("spring-boot-starter-parent")).alias("parent"),
        F.struct(F.when(every(2), "17").alias("java.version"), F.when(~every(2), "11").alias("maven.compiler.source")).alias("properties"),
        F.struct(F.array(
            F.when(every(4), dep("org.junit.jupiter", "junit-jupiter-api", "5.9.1")).otherwise(dep("junit", "junit", "4.13")),
            F.when(every(5), dep("org.mockito", "mockito-core", "5.2.0")).otherwise(dep("org.assertj", "assertj-core", "3.1")),
        ).alias("dependency")).alias("dependencies"),
        F.when(every(7), F.struct(F.struct(F.array(named("jacoco-maven-plugin")).alias("plugin")).alias("plugins"))).alias("build"),
    )
    return I.read_poms(t.spark, _written_xml(t, text, "project", "poms")).withColumnRenamed("artifactId", "module")


add(
    "s05_read_poms", lambda t: _poms(t).select("module", "packaging", "parent", "java_version", F.size("dependencies").alias("deps"), F.array_join("plugins", ",").alias("plugins")),
    """SELECT 'a' || CAST(p_partkey AS STRING) AS module, 'jar' AS packaging, CASE WHEN p_size % 3 = 0 THEN 'spring-boot-starter-parent' END AS parent, CASE WHEN p_size % 2 = 0 THEN '17' ELSE '11' END AS java_version,
              2 AS deps, CASE WHEN p_size % 7 = 0 THEN 'jacoco-maven-plugin' ELSE '' END AS plugins FROM part""",
)


def _profile(t):
    d = _poms(t).select("module", F.explode("dependencies").alias("d"))
    return C.module_profile(d.select("module", F.col("d.groupId").alias("group_id"), F.col("d.artifactId").alias("artifact_id"), F.col("d.version").alias("version")))


_PROFILE = """profile AS (SELECT 'a' || CAST(p_partkey AS STRING) AS module, CASE WHEN p_size % 4 = 0 THEN 'junit5' ELSE 'junit4' END AS test_framework, CASE WHEN p_size % 5 = 0 THEN 'mockito' ELSE 'unknown' END AS mock_framework,
    CASE WHEN p_size % 5 = 0 THEN 'plain' ELSE 'assertj' END AS assertions, p_size % 5 = 0 AS inline_mocks, FALSE AS spring_test, FALSE AS testcontainers, '' AS processors,
    CASE WHEN p_size % 4 = 0 THEN '5.9.1' ELSE '4.13' END AS test_version, CASE WHEN p_size % 5 = 0 THEN '5.2.0' ELSE 'unknown' END AS mock_version FROM part)"""
add("a28_module_profile", _profile, f"WITH {_PROFILE} SELECT * FROM profile")
add("a26_unresolved_versions", lambda t: C.unresolved_versions(_profile(t)), f"WITH {_PROFILE} SELECT module, 'mock_version' AS missing FROM profile WHERE mock_version = 'unknown'")
_PARENTS = {"spring-boot-starter-parent": "java-21"}
add(
    "a32_archetype", lambda t: C.archetype(_poms(t), _PARENTS),
    """SELECT 'a' || CAST(p_partkey AS STRING) AS module, CASE WHEN p_size % 3 = 0 THEN 'java-21' ELSE 'unknown' END AS archetype, CASE WHEN p_size % 3 = 0 THEN '21' END AS java, CASE WHEN p_size % 3 = 0 THEN '3.x' END AS framework,
              CASE WHEN p_size % 3 = 0 THEN 'jakarta' ELSE 'none' END AS namespace, CASE WHEN p_size % 3 = 0 THEN 'inherited' ELSE 'absent' END AS coverage_plugin, p_size % 3 = 0 AS inherited FROM part""",
)
add(
    "j20_pom_decision", lambda t: (lambda p: C.pom_decision(p, C.archetype(p, _PARENTS)))(_poms(t)),
    "SELECT 'a' || CAST(p_partkey AS STRING) AS module, CASE WHEN p_size % 7 = 0 THEN 'none' WHEN p_size % 3 = 0 THEN 'forbidden' ELSE 'add' END AS decision FROM part",
)
add(
    "j18_inherit_profile",
    lambda t: C.inherit_profile(
        t("part").selectExpr("concat('a', p_partkey) AS module", "CASE WHEN p_size % 2 = 0 THEN 'unknown' ELSE 'junit4' END AS test_framework", "CASE WHEN p_partkey < 20 THEN 'mockito' ELSE 'unknown' END AS mock_framework",
                             "'unknown' AS test_version", "CASE WHEN p_size % 3 = 0 THEN '1.0' END AS mock_version", "CASE WHEN p_size % 2 = 0 THEN 'lombok' ELSE 'mapstruct' END AS processors"),
        t("part").selectExpr("concat('a', p_partkey) AS module", "CASE WHEN p_partkey > 20 THEN concat('a', p_partkey % 20 + 1) END AS parent"),
    ),
    """WITH m AS (SELECT p_partkey AS k, 'a' || CAST(p_partkey AS STRING) AS module, CASE WHEN p_size % 2 = 0 THEN 'unknown' ELSE 'junit4' END AS tf, CASE WHEN p_partkey < 20 THEN 'mockito' ELSE 'unknown' END AS mf,
           CASE WHEN p_size % 3 = 0 THEN '1.0' ELSE 'unknown' END AS mv, CASE WHEN p_size % 2 = 0 THEN 'lombok' ELSE 'mapstruct' END AS p FROM part)
       SELECT a.module, CASE WHEN a.tf <> 'unknown' THEN a.tf ELSE coalesce(b.tf, 'unknown') END AS test_framework, CASE WHEN a.mf <> 'unknown' THEN a.mf ELSE coalesce(b.mf, 'unknown') END AS mock_framework,
              'unknown' AS test_version, CASE WHEN a.mv <> 'unknown' THEN a.mv ELSE coalesce(b.mv, 'unknown') END AS mock_version, array_to_string(list_sort(list_distinct([a.p, coalesce(b.p, a.p)])), ',') AS processors
       FROM m a LEFT JOIN m b ON a.k > 20 AND b.k = a.k % 20 + 1""",
)
add(
    "j19_fill_versions",
    lambda t: C.fill_versions(
        t("part").selectExpr("concat('a', p_partkey) AS module", "CASE WHEN p_size % 2 = 0 THEN '9' ELSE 'unknown' END AS test_version", "CAST(NULL AS STRING) AS mock_version"),
        t("part").selectExpr("concat('a', p_partkey) AS module", "CASE p_size % 3 WHEN 0 THEN 'junit' WHEN 1 THEN 'mockito-inline' ELSE 'odd' END AS artifact", "concat('v', p_size) AS version"),
    ),
    """SELECT 'a' || CAST(p_partkey AS STRING) AS module, CASE WHEN p_size % 2 = 0 THEN '9' WHEN p_size % 3 = 0 THEN 'v' || CAST(p_size AS STRING) ELSE 'unknown' END AS test_version,
              CASE WHEN p_size % 3 = 1 THEN 'v' || CAST(p_size AS STRING) ELSE 'unknown' END AS mock_version FROM part""",
)
add(
    "p21_resolve_property", lambda t: t("part").select("p_partkey", S.resolve_property(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("$"), F.lit("{v}"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("$"), F.lit("{w}"))).otherwise("1.2"),
                                                                                        F.create_map(F.lit("v"), F.col("p_brand"))).alias("value")),
    "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN '$' || '{w}' ELSE '1.2' END AS value FROM part",
)
_NAMESPACES = """WITH u AS (SELECT page_id, regexp_replace(url, '^[A-Za-z]+://', '') AS b FROM pages),
       p AS (SELECT page_id, list_concat(list_reverse(list_filter(string_split(regexp_replace(lower(regexp_extract(b, '^([^/?#]*)', 1)), ':[0-9]+$', ''), '.'), lambda x : x <> '' AND x <> 'www')),
                  list_filter(string_split(regexp_extract(b, '^[^/?#]*/?([^?#]*)', 1), '/'), lambda x : x <> '')) AS l FROM u)
       SELECT page_id, coalesce(array_to_string(list_transform(l, lambda x : CASE WHEN regexp_matches(lower(x), '^[0-9]') THEN '_' ELSE '' END || regexp_replace(lower(x), '[^a-z0-9_]', '_', 'g')), '.'), '') AS package FROM p"""
add("p12_namespace_to_package", lambda t: t("pages").select("page_id", S.namespace_to_package(F.col("url")).alias("package")), _NAMESPACES)
add(
    "s13_read_wsdl_packages",
    lambda t: I.read_wsdl_packages(t.spark, _written(t, t("pages").select(F.concat(F.lit('<definitions targetNamespace="'), F.col("url"), F.lit('"/>'))), "wsdl")).select("package").distinct(),
    f"WITH n AS ({_NAMESPACES}) SELECT DISTINCT n.package FROM n JOIN pages USING (page_id) WHERE url IS NOT NULL",
)
_KIND = """CASE WHEN lower(path) LIKE '%.java' THEN CASE WHEN regexp_matches(lower(path), '/controller/|controller\\.java$') THEN 'java-controller' WHEN regexp_matches(lower(path), '/service/|service\\.java$|serviceimpl') THEN 'java-service'
    WHEN regexp_matches(lower(path), '/repository/|repository\\.java$') THEN 'java-repository' ELSE 'java' END WHEN regexp_matches(lower(path), '\\.(yml|yaml|properties)$') THEN 'config' WHEN lower(path) LIKE '%.md' THEN 'docs' ELSE 'other' END"""
add(
    "p03_classify_path", lambda t: t("source_files").select("doc_id", I.classify_path(F.col("path")).alias("kind"), I.is_relevant(F.col("path")).alias("relevant")),
    f"SELECT doc_id, {_KIND} AS kind, NOT regexp_matches(path, '^(target|\\.git)/') AS relevant FROM source_files",
)
_CODE = "concat('import a.b;\\n/* c \\n d */ x = \"s t\"; // e', doc_id, '\\nchar c = \\'q\\'; y')"
add(
    "p04_strip_noise", lambda t: t("documents").selectExpr("doc_id", f"{_CODE} AS code").select("doc_id", F.regexp_replace(S.strip_noise(F.col("code")), r"\s+", " ").alias("bare")),
    "SELECT doc_id, ' x = \"\"; char c = ''''; y' AS bare FROM documents",
)
add(
    "p05_java_facts",
    lambda t: t("classes").select("class_no", S.java_facts(F.concat(F.lit("package a.p;\nimport b.C;\nimport static d.E.*;\n@Service @Data class K"), F.col("class_no").cast("string"), F.lit(" { List x; }"))).alias("f"))
    .select("class_no", "f.package", F.array_join("f.imports", ",").alias("imports"), F.array_join("f.annotations", ",").alias("annotations")),
    "SELECT class_no, 'a.p' AS package, 'b.C,d.E.*' AS imports, 'Data,Service' AS annotations FROM classes",
)
_LOG = """CASE event_id % 6 WHEN 0 THEN concat('[ERROR] C:/x/F', event_id, '.java:[', event_id % 9, ',3] cannot find symbol class K', event_id % 5) WHEN 1 THEN '[ERROR] /y/G.java:[1,2] incompatible types: int cannot be converted to String'
    WHEN 2 THEN '[INFO] fine' WHEN 3 THEN '[ERROR] /z/H.java:[7,8] package q.r does not exist' WHEN 4 THEN '[ERROR] /z/H.java:[7,8] odd' ELSE 'noise' END"""


def _lines(t, text, by="user_id % 60"):
    return t("events").selectExpr(f"concat('run', {by}) AS run_id", f"CAST(row_number() OVER (PARTITION BY {by} ORDER BY event_id) AS INT) AS line_no", f"{text} AS line", "event_id")


add(
    "c03_parse_build_errors", lambda t: C.parse_build_errors(_lines(t, _LOG).drop("event_id")),
    """WITH l AS (SELECT 'run' || CAST(user_id % 60 AS STRING) AS run_id, event_id, event_id % 6 AS k FROM events),
       e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS n FROM l WHERE k NOT IN (2, 5))
       SELECT run_id, 'maven' AS format, CASE k WHEN 0 THEN 'C:/x/F' || CAST(event_id AS STRING) || '.java' WHEN 1 THEN '/y/G.java' ELSE '/z/H.java' END AS file, CAST(CASE k WHEN 0 THEN event_id % 9 WHEN 1 THEN 1 ELSE 7 END AS INTEGER) AS line,
              CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 8 END AS col, CASE k WHEN 0 THEN 'cannot find symbol class K' || CAST(event_id % 5 AS STRING) WHEN 1 THEN 'incompatible types: int cannot be converted to String' WHEN 3 THEN 'package q.r does not exist' ELSE 'odd' END AS message,
              CASE k WHEN 0 THEN 'E_IMPORT_UNRESOLVED' WHEN 1 THEN 'E_TYPE_MISMATCH' WHEN 3 THEN 'E_PACKAGE_UNRESOLVED' ELSE 'E_OTHER' END AS code, CASE k WHEN 0 THEN 'K' || CAST(event_id % 5 AS STRING) WHEN 1 THEN 'int' WHEN 3 THEN 'q.r' ELSE '' END AS symbol,
              printf('err:%04d', n) AS err_id FROM e""",
)
_FORMATS = """CASE user_id % 3 WHEN 1 THEN CASE event_id % 6 WHEN 0 THEN concat(event_id, '. ERROR in /x/F', event_id, '.java (at line ', event_id % 9, ')') WHEN 1 THEN concat('\\tint a', event_id, ' = b;') WHEN 2 THEN '\\t^^^'
    WHEN 3 THEN '\\tType mismatch: cannot convert from int to String' WHEN 4 THEN CASE WHEN event_id % 7 = 0 THEN '----------' ELSE 'info' END ELSE 'noise' END
    WHEN 2 THEN CASE WHEN event_id % 6 < 3 THEN concat('src/F', event_id, '.java(3, 9): error: method does not override') ELSE '----------' END
    ELSE CASE event_id % 6 WHEN 0 THEN '[ERROR] /y/G.java:[1,2] package q.r does not exist' WHEN 1 THEN 'src/F.java(3, 9): error: hidden' ELSE '\\tat x' END END"""
add(  # segments of a few lines, so that blocks and counts go over them
    "c03_parse_build_errors_formats", lambda t: C.parse_build_errors(_lines(t, _FORMATS, "user_id % 30").drop("event_id"), segment_lines=7).select("run_id", "format", "file", "line", "col", "message", "code", "symbol", "err_id"),
    """WITH l AS (SELECT 'run' || CAST(user_id % 30 AS STRING) AS run_id, event_id AS e, event_id % 6 AS k, user_id % 3 AS f FROM events),
       b AS (SELECT *, SUM(CASE WHEN f = 1 AND k = 4 AND e % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY e) AS blk FROM l),
       s AS (SELECT *, last_value(CASE WHEN f = 1 AND k = 1 THEN 'int a' || CAST(e AS STRING) || ' = b;' WHEN f = 1 AND k = 3 THEN 'Type mismatch: cannot convert from int to String' END IGNORE NULLS)
                    OVER (PARTITION BY run_id, blk ORDER BY e ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS said FROM b),
       h AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY e) AS n FROM s WHERE (f = 1 AND k = 0) OR (f = 2 AND k < 3) OR (f = 0 AND k = 0)),
       m AS (SELECT *, CASE f WHEN 1 THEN coalesce(said, 'unknown error') WHEN 2 THEN 'method does not override' ELSE 'package q.r does not exist' END AS message FROM h)
       SELECT run_id, CASE f WHEN 1 THEN 'jdt' WHEN 2 THEN 'vscode' ELSE 'maven' END AS format, CASE f WHEN 1 THEN '/x/F' || CAST(e AS STRING) || '.java' WHEN 2 THEN 'src/F' || CAST(e AS STRING) || '.java' ELSE '/y/G.java' END AS file,
              CAST(CASE f WHEN 1 THEN e % 9 WHEN 2 THEN 3 ELSE 1 END AS INTEGER) AS line, CASE f WHEN 1 THEN 1 WHEN 2 THEN 9 ELSE 2 END AS col, message,
              CASE WHEN f = 2 THEN 'E_OVERRIDE' WHEN f = 0 THEN 'E_PACKAGE_UNRESOLVED' WHEN message LIKE 'Type%' THEN 'E_TYPE_MISMATCH' ELSE 'E_OTHER' END AS code,
              CASE WHEN f = 0 THEN 'q.r' WHEN message LIKE 'Type%' THEN 'int' ELSE '' END AS symbol, printf('err:%04d', n) AS err_id FROM m""",
)
add(
    "s10_read_build_logs",
    lambda t: I.read_build_logs(t.spark, _written(t, _lines(t, _LOG).select("line"), "logs")).groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("line <> ''"),
    """SELECT CASE event_id % 6 WHEN 0 THEN '[ERROR] C:/x/F' || CAST(event_id AS STRING) || '.java:[' || CAST(event_id % 9 AS STRING) || ',3] cannot find symbol class K' || CAST(event_id % 5 AS STRING)
              WHEN 1 THEN '[ERROR] /y/G.java:[1,2] incompatible types: int cannot be converted to String' WHEN 2 THEN '[INFO] fine' WHEN 3 THEN '[ERROR] /z/H.java:[7,8] package q.r does not exist' WHEN 4 THEN '[ERROR] /z/H.java:[7,8] odd' ELSE 'noise' END AS line,
              count(*) AS n FROM events GROUP BY 1""",
)
_TRACE = """CASE event_id % 5 WHEN 0 THEN concat('java.lang.IllegalStateException: bad ', event_id % 7) WHEN 1 THEN '\\tat org.junit.X.run(X.java:9)' WHEN 2 THEN concat('\\tat com.acme.Foo.m', event_id % 3, '(Foo.java:', event_id % 50, ')')
    WHEN 3 THEN '\\tat com.acme.FooTest.shouldRun(FooTest.java:5)' ELSE '\\t... 3 more' END"""


def _trace_lines(t):
    return _lines(t, _TRACE, "user_id").select(F.col("run_id").alias("trace_id"), "line_no", "line")


add(
    "c06_parse_stack_traces", lambda t: C.parse_stack_traces(_trace_lines(t)),
    """WITH l AS (SELECT 'run' || CAST(user_id AS STRING) AS trace_id, event_id AS e, event_id % 5 AS k FROM events),
       h AS (SELECT trace_id, arg_min('bad ' || CAST(e % 7 AS STRING), e) AS message FROM l WHERE k = 0 GROUP BY 1),
       f AS (SELECT trace_id, e, k, CASE k WHEN 1 THEN 'org.junit.X.run' WHEN 2 THEN 'com.acme.Foo.m' || CAST(e % 3 AS STRING) ELSE 'com.acme.FooTest.shouldRun' END AS fu,
                CASE k WHEN 1 THEN 'org.junit.X.run:9' WHEN 2 THEN 'com.acme.Foo.m' || CAST(e % 3 AS STRING) || ':' || CAST(e % 50 AS STRING) ELSE 'com.acme.FooTest.shouldRun:5' END AS n, row_number() OVER (PARTITION BY trace_id ORDER BY e) AS r FROM l WHERE k IN (1, 2, 3)),
       s AS (SELECT trace_id, arg_min(n, e) FILTER (k > 1) AS relevant_frame, arg_min(CASE k WHEN 2 THEN 'com.acme.Foo#m' || CAST(e % 3 AS STRING) ELSE 'com.acme.FooTest#shouldRun' END, e) FILTER (k > 1) AS symbol, arg_min(n, e) FILTER (k = 3) AS test_frame, string_agg(fu, ';' ORDER BY e) FILTER (r <= 5) AS top_frames, count(*) AS frames, count(*) FILTER (k > 1) AS user_frames FROM f GROUP BY 1)
       SELECT trace_id, 'java.lang.IllegalStateException' AS exception, message, 'E_ILLEGAL_STATE' AS error_code, relevant_frame, symbol, test_frame, top_frames, frames, user_frames FROM h LEFT JOIN s USING (trace_id)""",
)
add(
    "f07_user_frames", lambda t: C.user_frames(C.parse_frames(_trace_lines(t)), "Foo$").select("trace_id", "full", F.col("line").alias("at_line")),
    "SELECT 'run' || CAST(user_id AS STRING) AS trace_id, 'com.acme.Foo.m' || CAST(event_id % 3 AS STRING) AS \"full\", CAST(event_id % 50 AS INTEGER) AS at_line FROM events WHERE event_id % 5 = 2",
)
_TESTS = """CASE class_no % 8 WHEN 0 THEN 'Thread.sleep(5);' WHEN 1 THEN 'x = Math.random( );' WHEN 2 THEN 'Awaitility.await().until(x);' WHEN 3 THEN 'assertTrue(true);' WHEN 4 THEN concat('mock(', substring_index(fqcn, '.', -1), '.class); mock(String.class);')
    WHEN 5 THEN 'verifyNoMoreInteractions(a);' WHEN 6 THEN '  private static int n = 3;' ELSE 'new Foo_Builder(); // Thread.sleep(1)' END"""
add(
    "c07_lint_tests", lambda t: C.lint_tests(t("classes").selectExpr("fqcn AS file", f"{_TESTS} AS body", "substring_index(fqcn, '.', -1) AS sut")),
    """WITH k AS (SELECT k, rule FROM (VALUES (0, 'SLEEP'), (1, 'NON_DETERMINISTIC'), (2, 'AWAIT_NO_TIMEOUT'), (3, 'TAUTOLOGY'), (4, 'MOCKS_SUT'), (4, 'MOCKS_VALUE_TYPE'), (5, 'OVER_VERIFY'), (6, 'MUTABLE_STATIC'), (7, 'GENERATED_BUILDER')) AS x(k, rule))
       SELECT fqcn AS file, rule AS kind FROM classes JOIN k ON class_no % 8 = k""",
)
_METHODS = """concat('class T { @Test void ', CASE WHEN class_no % 2 = 0 THEN 'shouldRun_whenAsked' ELSE 'bad' END, '() { ', CASE WHEN class_no % 3 = 0 THEN '// given\\n// when\\n// then\\n' WHEN class_no % 3 = 1 THEN '// when\\n// given\\n// then\\n' ELSE '' END,
    CASE WHEN class_no % 5 = 0 THEN 'if (a) { b(); } ' ELSE '' END, CASE WHEN class_no % 7 = 0 THEN '' ELSE 'assertEquals(1, 1); ' END, '} @Test void shouldStop_whenTold() { /* given */ verify(x); } }')"""
_STACKS = [("junit5", "mockito", True, True), ("junit4", "mockito", False, False), ("unknown", "powermock", False, False), ("junit5", "unknown", False, True), ("junit5", "mockito", False, False)]
_USED = ("org.junit.jupiter.api.Test", "org.junit.Test", "org.mockito.Mock", "org.powermock.X", "org.springframework.test.Y", "org.junit.runner.RunWith", "java.util.List")


def _stacks(t):
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in _STACKS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t("part").select(F.concat(F.lit("m"), (F.col("p_partkey") % 5).cast("string")).alias("module"), *[pick(i).alias(n) for i, n in enumerate(("test_framework", "mock_framework", "inline_mocks", "spring_test"))]).distinct()


add(
    "c07_lint_stack",
    lambda t: C.lint_stack(
        t("classes").select(F.col("fqcn").alias("file"), F.element_at(F.array(*[F.lit(x) for x in _USED]), (F.col("class_no") % 7 + 1).cast("int")).alias("import")),
        t("classes").selectExpr("fqcn AS file", "concat('m', class_no % 6) AS module", "CASE WHEN class_no % 2 = 0 THEN 'try (var m = mockStatic(A.class)) {}' ELSE '// mockStatic(A.class)' END AS body"), _stacks(t),
    ),
    """WITH f AS (SELECT fqcn, class_no % 6 AS m, class_no % 7 AS i, class_no % 2 = 0 AS st FROM classes), k AS (SELECT *, m IN (0, 3, 4) AS j5, m IN (0, 1, 4) AS mo, m = 2 AS pw, m IN (0, 3) AS sp FROM f)
       SELECT fqcn AS file, CASE WHEN i IN (0, 1, 5) THEN 'JUNIT_VERSION_MISMATCH' ELSE 'FRAMEWORK_NOT_IN_STACK' END AS kind,
              CASE i WHEN 0 THEN 'org.junit.jupiter.api.Test' WHEN 1 THEN 'org.junit.Test' WHEN 2 THEN 'org.mockito.Mock' WHEN 3 THEN 'org.powermock.X' WHEN 4 THEN 'org.springframework.test.Y' ELSE 'org.junit.runner.RunWith' END AS subject
       FROM k WHERE (i = 0 AND NOT j5) OR (i IN (1, 5) AND j5) OR (i = 2 AND NOT mo) OR (i = 3 AND NOT pw) OR (i = 4 AND NOT sp)
       UNION ALL SELECT fqcn, 'FEATURE_NOT_IN_STACK', 'mockStatic' FROM k WHERE st AND m IN (1, 4)""",
)
add(
    "c08_lint_methods", lambda t: C.lint_methods(C.split_test_methods(t("classes").selectExpr("fqcn AS file", f"{_METHODS} AS body"), C.METHOD_FACTS)),
    """WITH r AS (SELECT fqcn AS file, 0 AS pos, CASE WHEN class_no % 2 = 0 THEN 'shouldRun_whenAsked' ELSE 'bad' END AS name, class_no AS n FROM classes)
       SELECT file, pos, name, 'NAMING' AS kind FROM r WHERE n % 2 = 1 UNION ALL SELECT file, pos, name, 'AAA_MISSING' FROM r WHERE n % 3 = 2 UNION ALL SELECT file, pos, name, 'AAA_ORDER' FROM r WHERE n % 3 = 1
       UNION ALL SELECT file, pos, name, 'CONTROL_FLOW' FROM r WHERE n % 5 = 0 UNION ALL SELECT file, pos, name, 'ASSERT_FREE' FROM r WHERE n % 7 = 0 UNION ALL SELECT file, 1, 'shouldStop_whenTold', 'AAA_MISSING' FROM r""",
)
add(
    "c10_lint_order_and_nulls",
    lambda t: C.lint_order_and_nulls(t("classes").selectExpr("fqcn AS file", "concat(CASE WHEN class_no % 2 = 0 THEN '@TestMethodOrder(X.class) ' ELSE '' END, CASE WHEN class_no % 4 = 0 THEN '// order: db\\n' ELSE '' END, CASE WHEN class_no % 3 = 0 THEN 'assertNotNull(new A());' ELSE 'assertNotNull(a);' END) AS body")),
    "SELECT fqcn AS file, 'ORDER_WITHOUT_REASON' AS kind FROM classes WHERE class_no % 2 = 0 AND class_no % 4 <> 0 UNION ALL SELECT fqcn, 'NOT_NULL_OF_LITERAL' FROM classes WHERE class_no % 3 = 0",
)
add(
    "a19_component_map", lambda t: C.component_map(t("source_files").select("repo", "path", "content")),
    f"""WITH k AS (SELECT repo, content, {_KIND} AS kind FROM source_files)
        SELECT repo, CASE WHEN kind IN ('java-controller', 'java-service', 'java-repository') THEN substr(kind, 6) ELSE 'other' END AS layer, count(*) AS files, CAST(0 AS BIGINT) AS packages, CAST(0 AS BIGINT) AS import_edges,
               {", ".join(f"bool_or(starts_with(kind, 'java') AND ({' OR '.join(f'contains(content, {chr(39)}{w}{chr(39)})' for w in words)})) AS {s}" for s, words in C.SIGNALS.items())},
               bool_or(kind = 'config' AND contains(content, 'management.endpoints')) AS actuator_configured FROM k GROUP BY 1, 2""",
)
add(
    "a19_package_files",
    lambda t: C.package_files(t("classes").selectExpr("repo", "concat('src/', fqcn, CASE WHEN class_no % 4 = 0 THEN '.kt' ELSE '.java' END) AS path", "concat(CASE WHEN class_no % 3 > 0 THEN concat('package a.p', class_no % 7, ';\\n') ELSE '' END, CASE WHEN class_no % 5 = 0 THEN '@Entity ' ELSE '' END, 'class X {}') AS content")),
    """WITH f AS (SELECT repo, class_no AS n, 'src/' || fqcn || '.java' AS path FROM classes WHERE class_no % 4 <> 0 AND class_no % 3 > 0)
       SELECT repo, 'a.p' || CAST(n % 7 AS STRING) AS package, path, CASE WHEN n % 6 = 0 THEN 'service' WHEN n % 6 = 1 THEN 'repository' WHEN n % 5 = 0 THEN 'entity' WHEN n % 6 = 2 THEN 'dto' ELSE 'other' END AS layer FROM f""",
)


def _findings(t):
    return C.architecture_findings(t("source_files").select("repo", "path", "content"))


_FIND = f"""k AS (SELECT repo, path, content, {_KIND} AS kind FROM source_files),
    f AS (SELECT repo, 'CRITICAL' AS severity, 'security' AS category, 'possible hard-coded secret' AS title, path AS evidence, path AS raw, 0.70::DOUBLE AS confidence FROM k
          WHERE kind = 'config' AND regexp_matches(content, '(?i)(password|secret|token|apikey|api_key)\\s*[:=]\\s*[''"]?[A-Za-z0-9_\\-]{{8,}}')
          UNION ALL SELECT repo, 'LOW', 'observability', 'prints to the console', path, path, 0.95 FROM k WHERE starts_with(kind, 'java') AND contains(content, 'System.out.println')
          UNION ALL SELECT repo, 'HIGH', 'layering', 'controller uses repository', path, path, CASE WHEN regexp_matches(content, '\\b([A-Z][A-Za-z0-9_]*)?Repository\\b') THEN 0.90 ELSE 0.85 END FROM k
          WHERE kind = 'java-controller' AND regexp_matches(content, '\\.repository\\.|\\b[A-Za-z0-9_]*Repository\\b')
          UNION ALL SELECT repo, 'INFO', 'observability', 'no management endpoints', coalesce(array_to_string(list_slice(list_sort(list(DISTINCT path) FILTER (kind = 'config')), 1, 5), ','), ''), coalesce(array_to_string(list_slice(list_sort(list(DISTINCT path) FILTER (kind = 'config')), 1, 5), '|'), ''), 0.55
          FROM k GROUP BY repo HAVING NOT bool_or(kind = 'config' AND contains(content, 'management.endpoints'))
          UNION ALL SELECT repo, 'MEDIUM', 'layering', 'controllers without services', array_to_string(list_slice(list_sort(list(DISTINCT path) FILTER (kind = 'java-controller')), 1, 10), ','),
          array_to_string(list_slice(list_sort(list(DISTINCT path) FILTER (kind = 'java-controller')), 1, 10), '|'), 0.65 FROM k GROUP BY repo HAVING bool_or(kind = 'java-controller') AND NOT bool_or(kind = 'java-service')),
    found AS (SELECT repo, 'arch-' || left(sha1(category || '|' || title || '|' || raw), 12) AS id, severity, category, title, evidence, confidence FROM f)"""
add("a20_architecture_findings", _findings, f"WITH {_FIND} SELECT * FROM found")
add(
    "a21_findings_by_severity", lambda t: C.findings_by_severity(_findings(t)),
    f"WITH {_FIND} SELECT severity, count(*) AS n, CAST(CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END AS INTEGER) AS rank FROM found GROUP BY severity",
)
add(
    "a27_quality_report",
    lambda t: C.quality_report(t("customer"), [("balance", "c_acctbal >= 0"), ("segment", "c_mktsegment IN ('BUILDING', 'MACHINERY')"), ("name", "c_name rlike '^Customer'"), ("key", "c_custkey > 0")], "c_custkey"),
    """WITH b AS (SELECT 'balance' AS rule, CAST(c_custkey AS STRING) AS k FROM customer WHERE NOT coalesce(c_acctbal >= 0, FALSE) UNION ALL SELECT 'segment', CAST(c_custkey AS STRING) FROM customer WHERE NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), FALSE)
           UNION ALL SELECT 'name', CAST(c_custkey AS STRING) FROM customer WHERE NOT coalesce(starts_with(c_name, 'Customer'), FALSE) UNION ALL SELECT 'key', CAST(c_custkey AS STRING) FROM customer WHERE NOT coalesce(c_custkey > 0, FALSE)),
       r AS (SELECT unnest(['balance', 'segment', 'name', 'key']) AS rule)
       SELECT rule, count(k) AS failing, coalesce(array_to_string(list_slice(list_sort(list(k) FILTER (k IS NOT NULL)), 1, 3), ','), '') AS sample FROM r LEFT JOIN b USING (rule) GROUP BY rule""",
)
add(
    "a30_generated_rules",
    lambda t: C.generated_rules(
        t("part").selectExpr("concat('r', p_partkey % 9) AS repo", "CASE p_size % 3 WHEN 0 THEN 'openapi-generator-maven-plugin' WHEN 1 THEN 'cxf-codegen-plugin' ELSE 'other' END AS plugin",
                             "CASE WHEN p_size % 4 = 0 THEN 'gen/cxf/' END AS source_root", "CASE WHEN p_size % 2 = 0 THEN concat('g.p', p_size) END AS package", "CASE WHEN p_size % 5 = 0 THEN concat('s', p_size, '.yml') END AS spec"),
        t("pages").select(F.concat(F.lit("r"), (F.col("page_id") % 9).cast("string")).alias("repo"), F.lit("w.s").alias("package")),
        t("orders").selectExpr("concat('r', o_orderkey % 9) AS repo", "CASE WHEN o_orderkey % 2 = 0 THEN concat('target/generated-sources/xsd/com/g/K', o_orderkey % 50, '.java') ELSE concat('s', o_orderkey % 20, '.yml') END AS path"),
        t("part").selectExpr("concat('r', p_partkey % 9) AS repo", "CASE WHEN p_size = 9 THEN 'org.projectlombok' WHEN p_size = 11 THEN 'com.google.auto.value' ELSE 'g' END AS group_id", "CASE WHEN p_size IN (9, 12) THEN 'lombok' ELSE 'mapstruct-x' END AS artifact_id"),
    ),
    """WITH a AS (SELECT 'r' || CAST(p_partkey % 9 AS STRING) AS repo, p_size AS z FROM part), p AS (SELECT * FROM a WHERE z % 3 < 2), s AS (SELECT 'r' || CAST(o_orderkey % 9 AS STRING) AS repo, o_orderkey AS o FROM orders)
       SELECT DISTINCT repo, 'package' AS rule_kind, 'g.p' || CAST(z AS STRING) AS pattern FROM p WHERE z % 2 = 0 UNION SELECT 'r' || CAST(page_id % 9 AS STRING), 'package', 'w.s' FROM pages
       UNION SELECT repo, 'fqcn', 'com.g.K' || CAST(o % 50 AS STRING) FROM s WHERE o % 2 = 0
       UNION SELECT repo, 'directory', d FROM a, (SELECT unnest(['target/generated-sources/**', 'build/generated/**', 'src/generated/**']) AS d)
       UNION SELECT repo, 'directory', CASE WHEN z % 4 = 0 THEN 'gen/cxf/**' ELSE 'target/generated-sources/cxf/**' END FROM p WHERE z % 3 = 1
       UNION SELECT repo, 'generator', CASE z % 3 WHEN 0 THEN 'openapi' ELSE 'cxf' END FROM p UNION SELECT repo, 'generator', CASE z WHEN 9 THEN 'lombok' ELSE 'autovalue' END FROM a WHERE z IN (9, 11)
       UNION SELECT repo, 'blocked', '' FROM p WHERE z % 5 <> 0
       UNION SELECT repo, 'blocked', 's' || CAST(z AS STRING) || '.yml' FROM p WHERE z % 5 = 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.repo = p.repo AND o % 2 = 1 AND o % 20 = z)""",
)
add(
    "a31_whitelist",
    lambda t: C.whitelist(t("whitelist").withColumn("origin", F.lit("jdk")), t("imports").select(F.lit("class").alias("level"), F.col("import").alias("name")).distinct().withColumn("origin", F.when(F.length("name") % 2 == 0, "dep").otherwise("source"))),
    """WITH u AS (SELECT level, name, 1 AS o FROM whitelist UNION ALL SELECT 'class', import, CASE WHEN length(import) % 2 = 0 THEN 0 ELSE 2 END FROM imports)
       SELECT level, name, CASE min(o) WHEN 0 THEN 'dep' WHEN 1 THEN 'jdk' ELSE 'source' END AS origin FROM u GROUP BY 1, 2""",
)


def _sunk(t):
    path = scratch(t.spark, "sink")
    B.write_table(t("classes"), path, ["repo"])
    B.write_table(t("classes").filter("repo = 'r1' AND class_no % 2 = 1"), path, ["repo"])
    return B.read_table(t.spark, path).select("fqcn", "repo", "class_no")


def _upserted(t):
    path, rows = scratch(t.spark, "upsert"), t("classes").select("fqcn", "kind")
    B.upsert_table(rows, path, ["fqcn"])
    B.upsert_table(t("classes").filter("class_no % 3 = 0").select("fqcn", F.lit("new").alias("kind")), path, ["fqcn"])
    B.upsert_table(t("classes").filter("class_no = 1").select(F.lit("z.Added").alias("fqcn"), F.lit("more").alias("kind")), path, ["fqcn"])
    return B.read_table(t.spark, path).select("fqcn", "kind")


add("s14_write_table", _sunk, "SELECT fqcn, repo, class_no FROM classes WHERE repo <> 'r1' OR class_no % 2 = 1")
add(
    "s15_upsert_by_key", lambda t: B.upsert_by_key(t("classes").select("fqcn", "kind"), t("classes").filter("class_no % 3 = 0").select("fqcn", F.lit("new").alias("kind")), ["fqcn"]),
    "SELECT fqcn, CASE WHEN class_no % 3 = 0 THEN 'new' ELSE kind END AS kind FROM classes",
)
add(
    "s15_upsert_table", _upserted,
    "SELECT fqcn, CASE WHEN class_no % 3 = 0 THEN 'new' ELSE kind END AS kind FROM classes UNION ALL SELECT 'z.Added', 'more' FROM classes WHERE class_no = 1",
)




def _state_documents(t):
    """One document a supplier, one a file in one flat folder; every fifth is cut short.  A folder a
    file would have to be made, listed and moved for each."""
    text = F.concat(F.lit('{"id": '), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 5 == 4, ', "kind": ').otherwise(F.concat(F.lit(',\n "kind": "'), F.col("s_name"), F.lit('"}'))))
    path = scratch(t.spark, "state")
    spread = t("supplier").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    files = spread.select(text.alias("value")).write.option("maxRecordsPerFile", 1)
    files.option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)  # a task moves its own files
    return I.read_state_json(t.spark, path, "id long, kind string")


add(
    "s11_read_state_json", lambda t: _state_documents(t)[0].select("id", "kind"),
    "SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS kind FROM supplier WHERE s_suppkey % 5 <> 4",
)
add(
    "s09_read_classpath_versions",
    lambda t: I.read_classpath_versions(
        t.spark, _written(t, t("part").select(F.concat(F.lit(":/m2/org/x/art"), (F.col("p_partkey") % 90).cast("string"), F.lit("/"), F.when(F.col("p_partkey") % 90 > 80, "v").otherwise(""), (F.col("p_partkey") % 90).cast("string"), F.lit("/a.jar:"))), "cp")
    ).select("artifact", "version").distinct(),
    "SELECT DISTINCT 'art' || CAST(p_partkey % 90 AS STRING) AS artifact, CAST(p_partkey % 90 AS STRING) AS version FROM part WHERE p_partkey % 90 <= 80",
)


def _zips(rows):
    """One archive of ``archive, entry, content`` rows each; the caller bounds their number."""

    def pack(key, pdf):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for entry, content in zip(pdf["entry"], pdf["content"], strict=True):
                z.writestr(entry, content)
        return pd.DataFrame({"path": [key[0]], "content": [out.getvalue()]})

    return rows.groupBy("archive").applyInPandas(pack, "path string, content binary")


def _sources(t):
    """Orders as XML below a source folder or a build folder, and as text, which is no source."""
    path = scratch(t.spark, "sources")
    rows = t("orders").select("o_orderkey")
    rows.filter("o_orderkey % 5 > 0").write.format("xml").option("rootTag", "rows").option("rowTag", "row").save(f"{path}/src")
    rows.filter("o_orderkey % 5 = 0").write.format("xml").option("rootTag", "rows").option("rowTag", "row").save(f"{path}/target")
    rows.select(F.format_string("<o_orderkey>%d</o_orderkey>", "o_orderkey")).write.text(f"{path}/notes")
    keys = F.regexp_extract_all("content", F.lit(r"<o_orderkey>(\d+)</o_orderkey>"), F.lit(1))
    return I.read_sources(t.spark, path).select("kind", F.explode(keys.cast("array<bigint>")).alias("o_orderkey"))


add("s06_read_sources", _sources, "SELECT 'other' AS kind, o_orderkey FROM orders WHERE o_orderkey % 5 > 0")
# forty parts an archive; every third archive has two top folders
_ENTRIES = """CASE p_size % 4 WHEN 0 THEN '/src/service/K' || k || '.java' WHEN 1 THEN '/target/K' || k || '.java' WHEN 2 THEN '/d' || k || '.md' ELSE '/b' || k || '.bin' END"""
_ARCHIVED = f"""SELECT archive, top, top || {_ENTRIES} AS entry, p_name AS content FROM (
    SELECT 'a' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) AS archive, CAST(p_partkey AS STRING) AS k, p_size, p_name,
           CASE WHEN floor(p_partkey / 40) % 3 = 0 THEN 't' || CAST(p_partkey % 2 AS STRING) ELSE 'top' END AS top FROM part) p"""
add(
    "s07_source_archives",
    lambda t: I.source_archives(_zips(t.spark.sql(_ARCHIVED.replace("FROM part)", "FROM {part})"), part=t("part")).drop("top"))),
    f"""WITH e AS ({_ARCHIVED}), n AS (SELECT archive, count(DISTINCT top) AS tops FROM e GROUP BY archive)
        SELECT e.archive, CASE WHEN tops = 1 THEN substr(entry, length(top) + 2) ELSE entry END AS path, CASE WHEN entry LIKE '%.md' THEN 'docs' ELSE 'java-service' END AS kind,
               CAST(strlen(content) AS BIGINT) AS size, content
        FROM e JOIN n USING (archive) WHERE entry LIKE '%.md' OR entry LIKE '%/service/%'""",
)


def _jars(t):
    k = F.col("p_partkey").cast("string")
    folder = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("p_partkey") % 700).cast("string"), F.lit("/q/")))
    names = F.array(F.concat(folder, F.lit("C"), k, F.lit(".class")), F.concat(folder, F.lit("C"), k, F.lit("$D.class")), F.concat(folder, F.lit("C"), k, F.lit(".txt")))
    rows = t("part").select(F.floor(F.col("p_partkey") / 40).cast("string").alias("archive"), F.explode(names).alias("entry"), F.lit("").alias("content"))
    return I.archive_entries(_zips(rows))


add(
    "s08_archive_entries", _jars,
    """WITH c AS (SELECT DISTINCT CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'p' || CAST(p_partkey % 700 AS STRING) || '.q' END AS package, p_partkey FROM part)
       SELECT CASE WHEN package = '' THEN '' ELSE package || '.' END || 'C' || CAST(p_partkey AS STRING) AS name, 'class' AS level, 'dep' AS origin FROM c
       UNION ALL SELECT DISTINCT package, 'package', 'dep' FROM c WHERE package <> ''""",
)
_RULE_LINES = """SELECT 'r' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) || CASE WHEN floor(p_partkey / 40) % 10 = 9 THEN '.txt' ELSE '.rules' END AS file, CAST(p_partkey % 40 AS INT) AS line,
    CASE p_size % 6 WHEN 0 THEN '"' || p_type || '" => addImport(' || p_brand || ')' WHEN 1 THEN '# "' || p_type || '" => addImport(x)' WHEN 2 THEN '' WHEN 3 THEN '  "' || p_type || '"=>escalateToLLM( ' || p_brand || ' ) '
        WHEN 4 THEN p_type || ' => addImport(x)' ELSE '"' || p_type || '" => somethingElse()' END AS text FROM part"""
add(
    "s12_parse_rules", lambda t: I.parse_rules(t.spark.sql(_RULE_LINES.replace("FROM part", "FROM {part}"), part=t("part"))).drop("rule_order"),
    """SELECT 'r' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) || '.rules' AS file, CAST(p_partkey % 40 + 1 AS INTEGER) AS line, p_type AS pattern,
              CASE p_size % 6 WHEN 0 THEN 'addImport' WHEN 3 THEN 'escalateToLLM' ELSE 'somethingElse' END AS action, CASE WHEN p_size % 6 = 5 THEN '' ELSE p_brand END AS args,
              CASE p_size % 6 WHEN 0 THEN 'MISSING_IMPORT' WHEN 3 THEN 'ESCALATED' ELSE 'GENERIC' END AS error_code, p_size % 6 <> 3 AS evidence_required
       FROM part WHERE p_size % 6 IN (0, 3, 5) AND floor(p_partkey / 40) % 10 <> 9""",
)
