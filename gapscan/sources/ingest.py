"""Readers of raw corpora, and sinks.  Formats are read by Spark's own sources with fixed
schemas; only zip archives need Python, one task an archive."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

_COUNTER = "counter array<struct<_type:string,_missed:long,_covered:long>>"
_COVERAGE = f"_name string, {_COUNTER}, method array<struct<_name:string,_desc:string,{_COUNTER.replace(' ', ':', 1)}>>"
_MUTATION = "_status string, mutatedClass string, mutatedMethod string, methodDescription string, lineNumber string, mutator string, description string"
_SUITE = "_name string, _failures long, _errors long, _tests long"
_DEP = "struct<groupId:string,artifactId:string,version:string,scope:string>"
_POM = (
    "groupId string, artifactId string, packaging string, parent struct<groupId:string,artifactId:string,version:string>, "
    "properties struct<`java.version`:string,`maven.compiler.release`:string,`maven.compiler.source`:string>, "
    f"dependencies struct<dependency:array<{_DEP}>>, build struct<plugins:struct<plugin:array<struct<artifactId:string,version:string>>>>"
)


def _xml(spark: SparkSession, path: str, row: str, schema: str, **options) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row).options(**options).schema(schema)
    return reader.load(path).withColumn("file", F.col("_metadata.file_path"))


def read_coverage_xml(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """S-1: one row for each class, method and counter (method null: the class's own)."""
    classes = _xml(spark, path, "class", _COVERAGE).withColumn("fqcn", F.regexp_replace("_name", "/", "."))
    # the class's own counters stand before its methods', as of one without a name: every report is parsed once
    own = F.struct(F.lit(None).cast("string").alias("_name"), F.lit(None).cast("string").alias("_desc"), F.col("counter"))
    owners = classes.select("file", "fqcn", F.posexplode(F.concat(F.array(own), F.coalesce("method", F.array()))).alias("pos", "m"))
    counters = owners.select("file", "fqcn", F.concat("m._name", "m._desc").alias("method"), (F.col("pos") - 1).alias("method_pos"), F.explode("m.counter").alias("c"))
    return counters.select(
        "file", F.lit(snapshot).alias("snapshot"), "fqcn", "method", "method_pos", F.col("c._type").alias("counter"), F.col("c._covered").alias("covered"), F.col("c._missed").alias("missed")
    )


def read_mutations_xml(spark: SparkSession, path: str) -> DataFrame:
    """S-2: status upper-cased, a bad line number is 0."""
    line = F.coalesce(F.col("lineNumber").try_cast("int"), F.lit(0))
    return _xml(spark, path, "mutation", _MUTATION).select(
        "file", F.upper("_status").alias("status"), F.col("mutatedClass").alias("fqcn"), F.concat("mutatedMethod", F.coalesce("methodDescription", F.lit(""))).alias("method"),
        line.alias("line"), "mutator", F.coalesce("description", F.lit("")).alias("description"),
    )


def latest_report(df: DataFrame, pattern: str = r"/([^/]+)/(\d{8,})/[^/]*$") -> DataFrame:
    """S-3: rows of the newest timestamp directory of each module, by file path."""
    rows = df.withColumn("module", F.regexp_extract("file", pattern, 1)).withColumn("__stamp", F.regexp_extract("file", pattern, 2))
    newest = rows.groupBy("module").agg(F.max("__stamp").alias("__stamp"))
    return rows.join(newest, ["module", "__stamp"], "left_semi").drop("__stamp")


def read_test_reports(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """S-4: passed or failed for each expected test class, NULL without a report."""
    suites = _xml(spark, path, "testsuite", _SUITE).groupBy(F.col("_name").alias("test_class")).agg(F.sum(F.col("_failures") + F.col("_errors")).alias("bad"))
    return expected.join(suites, "test_class", "left").select("test_class", F.when(F.col("bad") > 0, "failed").when(F.col("bad") == 0, "passed").alias("result"))


def read_poms(spark: SparkSession, path: str) -> DataFrame:
    """S-5: one row a build file, with its dependencies and plugins as arrays."""
    java = F.coalesce("properties.`java.version`", "properties.`maven.compiler.release`", "properties.`maven.compiler.source`")
    return _xml(spark, path, "project", _POM, ignoreNamespace="true").select(
        "file", "artifactId", F.coalesce("packaging", F.lit("jar")).alias("packaging"), F.col("parent.artifactId").alias("parent"), java.alias("java_version"),
        F.coalesce("dependencies.dependency", F.array().cast(f"array<{_DEP}>")).alias("dependencies"),
        F.coalesce(F.transform("build.plugins.plugin", lambda p: p["artifactId"]), F.array().cast("array<string>")).alias("plugins"),
    )


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """S-6: relevant files with kind, size and text."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("content"))
    return rows.filter(is_relevant(F.col("path"))).withColumn("kind", classify_path(F.col("path")))


def is_relevant(c):
    """P-3: worth reading: no build or version control output, a known suffix."""
    p = F.lower(F.regexp_replace(c, r"\\", "/"))
    out = p.rlike(r"(^|/)(target|build|dist|node_modules|\.git)/")
    known = p.rlike(r"(\.java|\.kt|\.xml|\.gradle|\.kts|\.yml|\.yaml|\.properties|\.md|dockerfile|jenkinsfile)$") | p.contains(".github/workflows/")
    return ~out & known


def classify_path(c):
    """P-3: the kind of a file by ordered rules."""
    p = F.lower(F.regexp_replace(c, r"\\", "/"))
    java = (
        F.when(p.rlike(r"/controller/|controller\.java$"), "java-controller").when(p.rlike(r"/service/|service\.java$|serviceimpl"), "java-service")
        .when(p.rlike(r"/repository/|repository\.java$"), "java-repository").when(p.rlike("/entity/|/model/"), "java-entity")
        .when(p.rlike(r"/dto/|dto\.java$"), "java-dto").when(p.contains("/config/"), "java-config").otherwise("java")
    )
    return (
        F.when(p.endswith(".java"), java).when(p.endswith("pom.xml"), "maven").when(p.rlike(r"build\.gradle(\.kts)?$"), "gradle").when(p.contains(".github/workflows/"), "ci")
        .when(p.rlike(r"\.(yml|yaml|properties)$"), "config").when(p.endswith("dockerfile"), "docker").when(p.endswith(".md"), "docs").otherwise("other")
    )


def _unzip(pdfs, with_text: bool):
    for pdf in pdfs:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = []
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                files = [info for info in z.infolist() if not info.is_dir()]
                tops = {info.filename.partition("/")[:2] for info in files}
                top = "/".join(next(iter(tops))[:1]) + "/" if len(tops) == 1 and all(slash for _, slash in tops) else ""
                for info in files:
                    rows.append((path, info.filename, info.filename[len(top) :], info.file_size, z.read(info).decode("utf-8", "replace") if with_text else ""))
                    if len(rows) >= 500:
                        yield pd.DataFrame(rows, columns=["archive", "entry", "path", "size", "content"])
                        rows = []
            yield pd.DataFrame(rows, columns=["archive", "entry", "path", "size", "content"])


def _archives(files: DataFrame, with_text: bool) -> DataFrame:
    kind = "archive string, entry string, path string, size long, content string"
    return files.select("path", "content").mapInPandas(lambda it: _unzip(it, with_text), kind)


def _binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def source_archives(files: DataFrame) -> DataFrame:
    """S-7: relevant files of zip archives (``path``, ``content``); a single common top
    folder is stripped, which the one reader of an archive sees by itself."""
    return _archives(files, True).filter(is_relevant(F.col("path"))).select("archive", "path", classify_path(F.col("path")).alias("kind"), "size", "content")


def read_source_archives(spark: SparkSession, path: str) -> DataFrame:
    """``source_archives`` of a folder."""
    return source_archives(_binary_files(spark, path))


def archive_entries(files: DataFrame) -> DataFrame:
    """S-8: classes (no nested ones) and packages of jars (``path``, ``content``)."""
    names = _archives(files, False).filter("entry LIKE '%.class' AND NOT contains(entry, '$')").select(F.regexp_replace(F.regexp_replace("entry", r"\.class$", ""), "/", ".").alias("name"))
    levels = F.array(F.struct(F.col("name"), F.lit("class").alias("level")), F.struct(S.package_of(F.col("name")).alias("name"), F.lit("package").alias("level")))
    return names.select(F.inline(levels)).filter("name <> ''").distinct().withColumn("origin", F.lit("dep"))


def read_archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """``archive_entries`` of a folder."""
    return archive_entries(_binary_files(spark, path))


def read_classpath_versions(spark: SparkSession, path: str) -> DataFrame:
    """S-9: artifact and version of each jar in a class path file, the first of each wins."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    jars = files.select("file", F.posexplode(F.split(F.trim("value"), "[:;]")).alias("pos", "jar")).filter("jar LIKE '%.jar'")
    pattern = r"/([^/]+)/([^/]+)/[^/]+\.jar$"
    rows = jars.select("file", "pos", F.regexp_extract("jar", pattern, 1).alias("artifact"), F.regexp_extract("jar", pattern, 2).alias("version")).filter("version rlike '^[0-9]'")
    return rows.groupBy("file", "artifact").agg(F.min_by("version", "pos").alias("version"))


def read_build_logs(spark: SparkSession, path: str) -> DataFrame:
    """S-10: numbered lines of each log."""
    logs = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return logs.select(F.col("_metadata.file_path").alias("run_id"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def read_state_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """S-11: one document a file; unreadable ones come second, as quarantine
    (all columns: Spark does not read the corrupt record alone)."""
    rows = spark.read.schema(schema + ", _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE").withColumn("file", F.col("_metadata.file_path"))
    return rows.filter("_corrupt_record IS NULL").drop("_corrupt_record"), rows.filter("_corrupt_record IS NOT NULL")


#: Rule action to error code (fixed values)
ACTION_CODES = {
    "addImport": "MISSING_IMPORT",
    "removeImport": "UNRESOLVABLE_IMPORT",
    "resolveUniqueImportFromWhitelist": "UNRESOLVED_TYPE",
    "removeUsageAndEscalate": "NON_PUBLIC_TYPE",
    "addAnnotation": "MISSING_ANNOTATION",
    "wrapWith": "MOCKITO_STRICT_STUBBING",
    "removeStub": "MOCKITO_UNNECESSARY_STUBBING",
    "useMockMaker": "MOCKITO_FINAL_CLASS",
    "normalizeMatchers": "MOCKITO_MATCHER_MISUSE",
    "replaceCall": "REPLACE_CALL",
    "addMockBean": "SPRING_MISSING_MOCKBEAN",
    "useBuilder": "BUILDER_REQUIRED",
    "insertAaaComments": "TQG_02_NO_AAA",
    "removeUnusedStub": "TQG_06_UNUSED_STUB",
    "convertMockSutToInjectMocks": "TQG_12_OVER_MOCK_SUT",
    "escalateToLLM": "ESCALATED",
}


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``parse_rules`` of a folder."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), "value")
    return parse_rules(files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text")))


def parse_rules(lines: DataFrame) -> DataFrame:
    """S-12: rules of ``.rules`` files (``file``, ``line`` from 0, ``text``) in file name and
    line order; comments and bad lines are dropped."""
    lines = lines.filter(F.col("file").endswith(".rules"))
    pattern = r'^\s*"((?:[^"\\]|\\.)*)"\s*=>\s*([A-Za-z_][A-Za-z0-9_]*)\((.*)\)\s*$'
    part = lambda i: F.regexp_extract("text", pattern, i)
    rows = lines.filter(~F.col("text").rlike(r"^\s*(#|$)") & F.col("text").rlike(pattern)).select("file", (F.col("line") + 1).alias("line"), part(1).alias("pattern"), part(2).alias("action"), F.trim(part(3)).alias("args"))
    codes = F.create_map(*[F.lit(x) for kv in ACTION_CODES.items() for x in kv])
    order = F.row_number().over(Window.orderBy("file", "line"))  # a rule list is short and kept by hand
    return rows.select(order.alias("rule_order"), "*", F.coalesce(F.try_element_at(codes, F.col("action")), F.lit("GENERIC")).alias("error_code"), (F.col("action") != "escalateToLLM").alias("evidence_required"))


def read_wsdl_packages(spark: SparkSession, path: str) -> DataFrame:
    """S-13: the packages of all target namespaces of each WSDL."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(r'targetNamespace\s*=\s*"([^"]*)"'), F.lit(1)))).alias("namespace"))
    return files.select("file", S.namespace_to_package(F.col("namespace")).alias("package")).distinct()
