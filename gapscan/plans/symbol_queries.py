"""Symbol tables, classification, graph and context packs."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import gates as G
from ..operators import graph as R
from ..operators import planning as P
from ..operators import symbols as Y
from ..operators.lineage import settled
from .adapters import sut
from .catalog import CATALOG
from .planning_queries import _ENRICH, _LAMBDA, _PLAN, _enriched

add = CATALOG.add


def _classes(t):
    return t("classes").withColumn("annotations", F.when(F.col("annotation").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("Slf4j"), F.col("annotation"))))


add(
    "c01_classify_classes", lambda t: Y.classify_classes(_classes(t), t("classes").filter("class_no % 31 = 0").select("fqcn")),
    """WITH x AS (SELECT *, CASE WHEN class_no % 31 = 0 THEN 'generated' END AS g,
           CASE annotation WHEN 'RestController' THEN 'controller' WHEN 'Service' THEN 'service' WHEN 'Repository' THEN 'repository' WHEN 'Configuration' THEN 'configuration' WHEN 'Mapper' THEN 'mapper' WHEN 'Component' THEN 'component' END AS a,
           CASE WHEN kind = 'interface' OR is_abstract THEN 'non-instantiable' END AS n, CASE kind WHEN 'record' THEN 'data-carrier' WHEN 'enum' THEN 'enum' END AS k,
           CASE class_no % 6 WHEN 0 THEN 'service' WHEN 1 THEN 'repository' WHEN 2 THEN 'data-carrier' WHEN 4 THEN 'mapper' END AS s FROM classes),
       y AS (SELECT fqcn, coalesce(g, a, n, k, s, 'component') AS type, CASE WHEN g IS NOT NULL THEN 'generated' WHEN a IS NOT NULL THEN 'annotation' WHEN n IS NOT NULL THEN 'abstract' WHEN k = 'data-carrier' THEN 'record'
           WHEN k IS NOT NULL THEN 'enum' WHEN s IS NOT NULL THEN 'suffix' ELSE 'default' END AS reason FROM x)
       SELECT fqcn, type, CASE WHEN type IN ('generated', 'non-instantiable', 'configuration') THEN 'high' WHEN type = 'controller' THEN 'medium' ELSE 'low' END AS testability_risk,
              CASE WHEN type IN ('controller', 'service') THEN 'high' WHEN type IN ('repository', 'component', 'mapper', 'util') THEN 'medium' ELSE 'low' END AS coverage_value,
              CASE WHEN type IN ('generated', 'non-instantiable', 'configuration') THEN NULL WHEN type = 'controller' THEN 'templates/webmvc-test.java' ELSE 'templates/junit5-mockito.java' END AS template, reason FROM y""",
)
add(
    "a11_annotation_index", lambda t: Y.annotation_index(t("members").withColumn("annotation", F.when(F.col("n_params") > 2, F.concat(F.lit("A"), F.col("n_params").cast("string")))), t("classes")),
    """WITH m AS (SELECT fqcn, name, CASE WHEN n_params > 2 THEN 'A' || CAST(n_params AS STRING) END AS annotation FROM members),
       u AS (SELECT fqcn AS key, annotation FROM classes UNION ALL SELECT fqcn, annotation FROM m UNION ALL SELECT fqcn || '#' || name, annotation FROM m)
       SELECT key, string_agg(DISTINCT annotation, ',' ORDER BY annotation) AS annotations FROM u WHERE annotation IS NOT NULL GROUP BY key""",
)
add(
    "a12_member_index", lambda t: Y.member_index(t("members")),
    f"""WITH u AS (SELECT * FROM members WHERE kind <> 'method' OR (usable AND NOT starts_with(name, '<')))
       SELECT fqcn, {", ".join(f"coalesce(string_agg(name, ',' ORDER BY pos) FILTER (kind = '{k}'), '') AS {k}s" for k in ("constructor", "method", "builder"))}, count(*) AS total FROM u GROUP BY fqcn""",
)
_BEST = """best AS (SELECT fqcn, name, visibility, n_params, pos, evidence_id FROM members WHERE kind = 'constructor' AND visibility IN ('public', 'package')
    QUALIFY row_number() OVER (PARTITION BY fqcn ORDER BY CASE visibility WHEN 'public' THEN 0 ELSE 1 END, n_params, pos) = 1)"""
add("w03_best_constructor", lambda t: Y.best_constructor(t("members")), f"WITH {_BEST} SELECT * FROM best")
add(
    "c02_build_fixtures",
    lambda t: Y.build_fixtures(
        t("members").selectExpr(
            "*", "n_params = 1 AS is_static", "CASE WHEN n_params = 1 AND pos = 2 THEN fqcn WHEN n_params = 1 THEN 'void' END AS return_type",
            "CASE WHEN kind = 'builder' AND n_params < 2 THEN concat(fqcn, '.Builder()') WHEN kind = 'builder' AND n_params = 2 THEN concat(fqcn, '_Builder()') ELSE 'make()' END AS entry", "CAST(NULL AS STRING) AS build",
        ),
        t("classes").withColumn("type", F.element_at(F.array(*[F.lit(x) for x in (*Y.VARIANTS, "odd")]), (F.col("class_no") % (len(Y.VARIANTS) + 1) + 1).cast("int"))),
    ),
    f"""WITH b AS (SELECT fqcn, fqcn || '.Builder() … build()' AS e FROM members WHERE kind = 'builder' AND n_params < 2),
       c AS (SELECT fqcn, evidence_id AS e FROM members WHERE kind = 'constructor' AND visibility = 'public' QUALIFY row_number() OVER (PARTITION BY fqcn ORDER BY n_params, pos) = 1),
       f AS (SELECT fqcn, evidence_id AS e FROM members WHERE kind = 'method' AND pos = 2 AND n_params = 1),
       x AS (SELECT k.fqcn, k.class_no % {len(Y.VARIANTS) + 1} AS v, k.kind = 'interface' OR k.is_abstract AS a, b.e AS be, c.e AS ce, f.e AS fe FROM classes k LEFT JOIN b USING (fqcn) LEFT JOIN c USING (fqcn) LEFT JOIN f USING (fqcn))
       SELECT fqcn, CASE WHEN a THEN 'mock' WHEN be IS NOT NULL THEN 'builder' WHEN ce IS NOT NULL THEN 'constructor' WHEN fe IS NOT NULL THEN 'factory' ELSE 'mock' END AS strategy,
              CASE WHEN NOT a THEN coalesce(be, ce, fe) END AS evidence, NOT a AND be IS NULL AND ce IS NULL AND fe IS NULL AS degraded,
              CASE WHEN NOT a AND be IS NULL AND ce IS NULL AND fe IS NULL THEN '' ELSE CASE v {" ".join(f"WHEN {i} THEN '{','.join(names)}'" for i, names in enumerate(Y.VARIANTS.values()))} ELSE 'happy-path' END END AS variants FROM x""",
)
add(
    "c02_fixture_values",
    lambda t: Y.fixture_values(t("members").select("fqcn", "pos", F.concat(F.lit(""), F.element_at(F.array(*[F.lit(x) for x in ("int", "String", "java.util.List<String>", "int[]", "a.B")]), (F.col("n_params") + 1).cast("int"))).alias("type")))
    .select("fqcn", F.map_keys("values").getItem(0).alias("first"), F.element_at("values", "arg5").alias("last")),
    """SELECT fqcn, 'arg0' AS first, CASE n_params WHEN 0 THEN '0' WHEN 1 THEN '""' WHEN 2 THEN 'Collections.emptyList()' WHEN 3 THEN 'new int[0]' ELSE 'null' END AS last FROM members WHERE pos = 5""",
)
add(
    "w10_dictionary_encode", lambda t: Y.dictionary_encode(t("members"), "fqcn", "visibility", "pos"),
    """SELECT fqcn, visibility, CAST(row_number() OVER (PARTITION BY fqcn ORDER BY f, visibility) - 1 AS INTEGER) AS code FROM (SELECT fqcn, visibility, min(pos) AS f FROM members GROUP BY 1, 2)""",
)



add(
    "p20_compact_imports",
    lambda t: Y.compact_imports(t("imports").select(F.col("patch_id").alias("fqcn"), "import").distinct().withColumn("pos", F.col("import"))),
    """WITH d AS (SELECT DISTINCT patch_id AS fqcn, import FROM imports), n AS (SELECT *, row_number() OVER (PARTITION BY fqcn ORDER BY import) AS n FROM d),
       k AS (SELECT *, regexp_extract(import, '^(.*)\\.[^.]*$', 1) AS p FROM n WHERE n <= 40), m AS (SELECT *, count(*) OVER (PARTITION BY fqcn, p) >= 3 AS many FROM k)
       SELECT fqcn, CASE WHEN many THEN p ELSE '_' END AS prefix, string_agg(CASE WHEN many THEN regexp_extract(import, '([^.]*)$', 1) ELSE import END, ',' ORDER BY n) AS leaves FROM m GROUP BY 1, 2""",
)
add(
    "p20_expand_imports",
    lambda t: Y.expand_imports(Y.compact_imports(t("imports").select(F.col("patch_id").alias("fqcn"), "import").distinct().withColumn("pos", F.col("import")))),
    """WITH d AS (SELECT DISTINCT patch_id AS fqcn, import FROM imports)
       SELECT fqcn, import FROM d QUALIFY row_number() OVER (PARTITION BY fqcn ORDER BY import) <= 40""",
)
add(
    "j17_resolve_type",
    lambda t: Y.resolve_type(
        t("classes").selectExpr("fqcn AS file", "concat('com.acme.p', class_no % 13) AS package", "CASE class_no % 4 WHEN 0 THEN fqcn WHEN 1 THEN 'Z' WHEN 2 THEN substring_index(fqcn, '.', -1) ELSE concat('C', class_no + 2, 'Repository') END AS name"),
        t("classes").filter("class_no % 3 = 0").selectExpr("fqcn AS file", "'q.r.Z' AS import"), t("classes"),
    ),
    """WITH u AS (SELECT fqcn AS file, class_no AS n, 'com.acme.p' || CAST(class_no % 13 AS STRING) AS package, CASE class_no % 4 WHEN 0 THEN fqcn WHEN 1 THEN 'Z' WHEN 2 THEN regexp_extract(fqcn, '([^.]*)$', 1) ELSE 'C' || CAST(class_no + 2 AS STRING) || 'Repository' END AS name FROM classes),
       s AS (SELECT regexp_extract(fqcn, '([^.]*)$', 1) AS name, min(fqcn) AS a FROM classes GROUP BY 1)
       SELECT file, package, u.name, coalesce(e.fqcn, CASE WHEN n % 3 = 0 AND u.name = 'Z' THEN 'q.r.Z' END, l.fqcn, s.a) AS resolved
       FROM u LEFT JOIN classes e ON e.fqcn = u.name LEFT JOIN classes l ON l.fqcn = u.package || '.' || u.name LEFT JOIN s ON s.name = u.name""",
)
_EDGES = "rev AS (SELECT DISTINCT dst AS src, src AS dst FROM dep_edges)"
_SEEDS = "seeds AS (SELECT DISTINCT 'n' || CAST(p_partkey AS STRING) AS fqcn FROM part WHERE p_size = 7)"


def _index(t):
    return t("dep_edges").groupBy("src").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("dst"))).alias(k) for k in ("uses", "injects", "extends")])


def _seeds(t):
    return t("part").filter("p_size = 7").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("fqcn"))


_WALK = f"""WITH RECURSIVE {_SEEDS}, {_EDGES}, walk AS (SELECT fqcn AS node, 0 AS hops FROM seeds UNION SELECT r.dst, w.hops + 1 FROM walk w JOIN rev r ON r.src = w.node WHERE w.hops < 3)
    SELECT node, min(hops) AS hops FROM walk GROUP BY node"""
add("g01_reverse_edges", lambda t: R.reverse_edges(_index(t)), f"WITH {_EDGES} SELECT * FROM rev")
add("g02_impact", lambda t: R.impact(_seeds(t), R.reverse_edges(_index(t))), _WALK)
add(
    "g03_build_dependencies",
    lambda t: R.build_dependencies(t("members"), t("dependencies").join(t("members").filter("kind = 'constructor'").select(F.col("fqcn").alias("sut"), "evidence_id"), "sut").select("evidence_id", "pos", "type"), t("classes")),
    f"""WITH {_BEST}, p AS (SELECT b.fqcn AS sut, d.pos, d.type FROM best b JOIN dependencies d ON d.sut = b.fqcn)
        SELECT p.sut, p.pos, p.type, lower(substr(regexp_extract(p.type, '([^.]*)$', 1), 1, 1)) || substr(regexp_extract(p.type, '([^.]*)$', 1), 2) AS name,
               CASE WHEN k.fqcn IS NOT NULL THEN k.kind = 'interface' OR k.is_abstract ELSE regexp_matches(p.type, '(Service|Repository)$') END AS mockable, FALSE AS external_client,
               CASE c.annotation WHEN 'RestController' THEN 'web' WHEN 'Repository' THEN 'data' WHEN 'Configuration' THEN 'context' ELSE 'unit' END AS slice
        FROM p LEFT JOIN classes k ON k.fqcn = p.type LEFT JOIN classes c ON c.fqcn = p.sut""",
)
add(
    "g04_dependency_index", lambda t: R.dependency_index(t("dependencies")),
    """SELECT sut, string_agg(DISTINCT type, ',' ORDER BY type) AS injects, coalesce(string_agg(DISTINCT type, ',' ORDER BY type) FILTER (NOT contains(type, 'Repository')), '') AS uses,
              coalesce(string_agg(DISTINCT type, ',' ORDER BY type) FILTER (contains(type, 'Repository')), '') AS repositories, '' AS clients FROM dependencies GROUP BY sut""",
)


def _cycle_edges(t):
    return t("part").selectExpr("concat('n', p_partkey) AS src", "concat('n', CASE WHEN p_partkey % 9 = 8 THEN p_partkey - 5 ELSE p_partkey + 1 END) AS dst")


add(
    "g05_fixture_cycles", lambda t: R.cycle_partners(R.fixture_cycles(_cycle_edges(t))),
    """WITH RECURSIVE e AS (SELECT p_partkey AS s, CASE WHEN p_partkey % 9 = 8 THEN p_partkey - 5 ELSE p_partkey + 1 END AS d FROM part),
       w AS (SELECT s, d FROM e UNION SELECT w.s, e.d FROM w JOIN e ON e.s = w.d)
       SELECT 'n' || CAST(a.s AS STRING) AS node, coalesce(string_agg(DISTINCT 'n' || CAST(a.d AS STRING), ',' ORDER BY 'n' || CAST(a.d AS STRING)) FILTER (a.s <> a.d), '') AS partners,
              least('n' || CAST(a.s AS STRING), min('n' || CAST(a.d AS STRING))) AS group_id, count(DISTINCT a.d) AS size
       FROM w a JOIN w b ON a.s = b.d AND a.d = b.s GROUP BY a.s""",
)
add(
    "j11_affected_tests",
    lambda t: Y.affected_tests(
        t("targets").select(F.concat("sut", F.lit("Test")).alias("test"), F.concat("sut", F.when(F.col("pos") % 2 == 0, F.concat(F.lit(".m"), F.col("pos").cast("string"))).otherwise("")).alias("import")),
        t("classes").selectExpr("concat(fqcn, 'IT') AS src", "fqcn AS dst").filter("length(dst) % 2 = 0"), t("affected"),
    ),
    """SELECT DISTINCT sut || 'Test' AS test FROM targets WHERE sut IN (SELECT fqcn FROM affected)
       UNION SELECT fqcn || 'IT' FROM classes WHERE length(fqcn) % 2 = 0 AND fqcn IN (SELECT fqcn FROM affected)""",
)
add(
    "j12_collaborator_usage", lambda t: Y.collaborator_usage(t("dependencies"), t("members")),
    """WITH m AS (SELECT fqcn, string_agg(name, ',' ORDER BY pos) AS methods FROM (SELECT *, row_number() OVER (PARTITION BY fqcn ORDER BY pos) AS n FROM members WHERE visibility = 'public' AND kind = 'method') WHERE n <= 10 GROUP BY 1)
       SELECT DISTINCT d.sut, d.type, m.methods FROM dependencies d JOIN m ON m.fqcn = d.type""",
)
add(
    "j13_dependency_strategy", lambda t: Y.dependency_strategy(t("dependencies"), t("fixtures")),
    "SELECT d.*, coalesce(f.s, 'mock') AS strategy FROM dependencies d LEFT JOIN (SELECT fqcn, min(strategy) AS s FROM fixtures GROUP BY 1) f ON f.fqcn = d.type",
)
_PRESETS = ("org.junit.jupiter.api.Test", "org.mockito.Mock")


def _allowed(t):
    return Y.allowed_imports(t("classes"), t("members"), t("dependencies"), t("whitelist"), _PRESETS)


_ALLOWED = """
    al AS (SELECT fqcn, fqcn AS import FROM classes UNION SELECT sut, type FROM dependencies UNION SELECT fqcn, throws FROM members WHERE throws = 'java.io.IOException'
        UNION SELECT c.fqcn, w.name FROM classes c JOIN whitelist w ON w.level = 'class' AND regexp_extract(w.name, '^(.*)\\.[^.]*$', 1) = regexp_extract(c.fqcn, '^(.*)\\.[^.]*$', 1)
        UNION SELECT fqcn, 'org.junit.jupiter.api.Test' FROM classes UNION SELECT fqcn, 'org.mockito.Mock' FROM classes),
    allowed AS (SELECT fqcn, string_agg(import, ',' ORDER BY import) AS imports FROM al WHERE fqcn IN (SELECT fqcn FROM classes) GROUP BY fqcn)"""
add("a22_allowed_imports", _allowed, f"WITH {_ALLOWED} SELECT * FROM allowed")
add(
    "a23_thrown_exceptions", lambda t: Y.thrown_exceptions(t("members")),
    "SELECT fqcn, string_agg(throws, ',' ORDER BY p, throws) AS throws FROM (SELECT fqcn, throws, min(pos) AS p FROM members WHERE throws IS NOT NULL GROUP BY 1, 2) GROUP BY fqcn",
)


def _packs(t):
    scored = _enriched(t).select("repo", "target_id", "sut", "pos", "missed_lines", "missed_branches", "testability_risk", "penalty", "boost")
    # the two large parts are settled one after the other, so that their shuffles are not on disk together
    targets, supply = P.plan_by_class(scored), settled(Y.class_supply(t("supplied"), t("fixtures")))
    return Y.context_pack_by_class(targets, t("classification"), t("coverage"), t("members"), supply, t("classes"), t("whitelist"), _PRESETS, G.failure_digest(t("failure_memory")))


add(
    "j16_context_pack", _packs,
    f"""WITH {_LAMBDA}, {_ENRICH}, {_PLAN}, {_ALLOWED.replace("FROM dependencies", "FROM supplied")},
        fl AS (SELECT *, split_part(symbol_fqn, '#', 1) AS sut FROM failure_memory WHERE last_result = 'FAILED' AND split_part(symbol_fqn, '#', 1) IN (SELECT sut FROM targets)),
        ag AS (SELECT *, row_number() OVER (PARTITION BY sut, error_code, fix_id ORDER BY last_seen_cycle DESC, event_id DESC) > 1 AS again FROM fl),
        di AS (SELECT *, row_number() OVER (PARTITION BY sut ORDER BY again, last_seen_cycle DESC, event_id DESC) AS place FROM ag),
        fs AS (SELECT fqcn AS type, min(strategy) AS strategy FROM fixtures GROUP BY 1),
        de AS (SELECT d.sut, d.type || ':' || coalesce(fs.strategy, 'mock') AS line, d.type FROM (SELECT DISTINCT sut, type FROM supplied) d LEFT JOIN fs USING (type)),
        p1 AS (SELECT sut, string_agg(target_id, ';' ORDER BY plan_rank, target_id) AS x FROM planned GROUP BY 1),
        p2 AS (SELECT fqcn AS sut, string_agg(kind || ':' || name, ';' ORDER BY pos, kind || ':' || name) AS x FROM members GROUP BY 1),
        p3 AS (SELECT sut, string_agg(line, ';' ORDER BY type) AS x FROM de GROUP BY 1),
        p4 AS (SELECT sut, string_agg(error_code || ':' || fix_id, ';' ORDER BY place) AS x FROM di WHERE place <= 8 GROUP BY 1),
        k AS (SELECT fqcn AS sut, max(type) AS type, max(template) AS template FROM classification GROUP BY 1),
        cv AS (SELECT fqcn AS sut, CAST(SUM(covered_lines) AS BIGINT) AS covered_lines FROM coverage GROUP BY 1),
        pk AS (SELECT p1.sut, k.type, k.template, cv.covered_lines, coalesce(al2.imports, '') AS imports, p1.x AS targets, coalesce(p2.x, '') AS members, coalesce(p3.x, '') AS dependencies, coalesce(p4.x, '') AS failures
               FROM p1 LEFT JOIN k USING (sut) LEFT JOIN cv USING (sut) LEFT JOIN (SELECT fqcn AS sut, imports FROM allowed) al2 USING (sut) LEFT JOIN p2 USING (sut) LEFT JOIN p3 USING (sut) LEFT JOIN p4 USING (sut))
        SELECT *, CAST(floor((strlen(sut) + strlen(imports) + strlen(targets) + strlen(members) + strlen(dependencies) + strlen(failures) + 5) * 0.25) AS BIGINT) AS pack_tokens FROM pk""",
)
#: A test file for each class of ``part``, as SQL for both engines: known and unknown types, shadowed
#: names, fields declared last, comments and literals that look like calls, throwables, statics, builders.
_CALLER = """concat('package com.acme.p', p_partkey % 13, ';\\nimport com.acme.odd.Ghost;\\n// x.nope(); new C0Service();\\nclass T', p_partkey, 'Test { String s = "self.fake()";\\n',
    ' void a(', simple, ' p) { ', simple, '.Builder b = new ', simple, '.Builder(); b.build(); b.do4(); b.lost(); p.do2(); p.size(); }\\n',
    ' void c() { ', simple, ' p = new ', simple, '(); p.do', p_size % 7, '(); p.getMessage(); self.do5(); { Ghost q = new Ghost(); q.zap(); } { ', simple, ' q = null; q.zap(); } q.gone(); }\\n',
    ' void d() { ', simple, '.do2(); ', fqcn, '.make(); Mockito.mock(1); new ', simple, '_Builder(); MyError e = null; e.getMessage(); e.lost(); }\\n ', simple, ' self; }')"""
_CALLERS = f"SELECT fqcn, split_part(fqcn, '.', 4) AS simple, p_partkey, p_size FROM (SELECT p_partkey, p_size, {sut('p_partkey')} AS fqcn FROM part) k"


def _called(t):
    t.base("part").createOrReplaceTempView("part")
    files = t.spark.sql(_CALLERS).selectExpr("concat(fqcn, 'Test.java') AS path", f"{_CALLER} AS content")
    classes = t("part").selectExpr(f"{sut('p_partkey')} AS fqcn", "CASE WHEN p_partkey % 10 = 0 THEN 'interface' ELSE 'class' END AS kind", "p_partkey % 14 = 0 AS is_abstract")
    extra = t.spark.createDataFrame([("com.acme.x.MyError", "class", False)], "fqcn string, kind string, is_abstract boolean")
    return files, classes.unionByName(extra)


def _lint(t):
    files, classes = _called(t)
    return Y.lint_symbols(Y.extract_calls(files, classes), classes, t("members")).select("file", "kind", "type", "method", "receiver", "fqcn", "fault")


#: What the files above do, by the rules of the contract
_USES = """u AS (SELECT k.fqcn || 'Test.java' AS file, k.fqcn, k.simple, p_partkey % 10 = 0 OR p_partkey % 14 = 0 AS abstract, x.* FROM callers k, LATERAL (VALUES
        ('builder', k.simple, NULL, NULL, 1), ('call', k.simple, 'build', 'b', 2), ('call', k.simple, 'do4', 'b', 3), ('call', k.simple, 'lost', 'b', 4), ('call', k.simple, 'do2', 'p', 5),
        ('new', k.simple, NULL, NULL, 6), ('call', k.simple, 'do' || CAST(p_size % 7 AS STRING), 'p', 7), ('call', k.simple, 'getMessage', 'p', 8), ('call', k.simple, 'do5', 'self', 9),
        ('call', k.simple, 'zap', 'q', 10), ('static', k.simple, 'do2', NULL, 11), ('static', k.fqcn, 'make', NULL, 12), ('generated', k.simple || '_Builder', NULL, NULL, 13)) x(kind, type, method, receiver, pos)),
    n AS (SELECT DISTINCT fqcn, unnest(CASE WHEN kind = 'builder' THEN [name, 'build'] ELSE [name] END) AS method FROM members WHERE usable AND kind IN ('method', 'builder')),
    m AS (SELECT fqcn, bool_or(kind = 'constructor' AND visibility <> 'private') AS nw, bool_or(kind = 'builder') AS bl FROM members WHERE usable GROUP BY 1),
    f AS (SELECT u.*, CASE WHEN u.kind = 'generated' THEN 'DIRECT_GENERATED_BUILDER_FORBIDDEN' WHEN u.kind = 'builder' AND NOT coalesce(bl, FALSE) THEN 'BUILDER_NOT_VERIFIED'
            WHEN u.kind = 'new' AND (abstract OR NOT coalesce(nw, FALSE)) THEN 'INSTANTIATION_NOT_ALLOWED' WHEN u.kind = 'call' AND n.method IS NULL THEN 'METHOD_NOT_IN_CONTRACT'
            WHEN u.kind = 'static' AND n.method IS NULL THEN 'STATIC_METHOD_NOT_IN_CONTRACT' END AS fault FROM u LEFT JOIN m USING (fqcn) LEFT JOIN n ON n.fqcn = u.fqcn AND n.method = u.method)"""
add(
    "c09_lint_symbols", _lint,
    f"""WITH callers AS ({_CALLERS}), {_USES}
        SELECT file, kind, type, method, receiver, CASE WHEN kind <> 'generated' THEN fqcn END AS fqcn, fault FROM f WHERE fault IS NOT NULL
        UNION ALL SELECT fqcn || 'Test.java', 'call', 'MyError', 'lost', 'e', 'com.acme.x.MyError', 'METHOD_NOT_IN_CONTRACT' FROM callers""",
)
_SOURCE = "concat('package com.acme.p', class_no % 5, ';\\n// class Not\\n@Service\\n', CASE WHEN class_no % 3 = 0 THEN '@Builder(x = 1) ' ELSE '' END, 'public final ', kind, ' T', class_no, ' { String s = \"class Nope\"; }\\nclass Inner {}')"
add(
    "c12_source_types", lambda t: Y.source_types(t("classes").selectExpr("fqcn AS path", f"{_SOURCE} AS content")).withColumn("annotations", F.array_join("annotations", ",")),
    """SELECT fqcn AS path, 0 AS pos, 'com.acme.p' || CAST(class_no % 5 AS STRING) || '.T' || CAST(class_no AS STRING) AS fqcn, kind, CASE WHEN class_no % 3 = 0 THEN 'Builder,Service' ELSE 'Service' END AS annotations, class_no % 3 = 0 AS has_builder FROM classes
       UNION ALL SELECT fqcn, 1, 'com.acme.p' || CAST(class_no % 5 AS STRING) || '.Inner', 'class', '', FALSE FROM classes""",
)
_BUILDER = "concat('class T', class_no, ' { static class Builder { Builder size(int n) { return this; } // Builder hidden(int n);\\n public abstract T', class_no, '.Builder names( java.util.List<String>  xs ); Builder size(int m); Builder mapIt(int n); T build(); Builder part', class_no % 4, '(String s); } }')"
add(
    "c12_builder_setters", lambda t: Y.builder_setters(t("classes").selectExpr("fqcn AS path", f"{_BUILDER} AS content")),
    """SELECT fqcn AS path, 'size' AS name, 'int' AS type, 0 AS pos FROM classes UNION ALL SELECT fqcn, 'names', 'java.util.List<String>', 1 FROM classes
       UNION ALL SELECT fqcn, 'part' || CAST(class_no % 4 AS STRING), 'String', 4 FROM classes""",
)
add(
    "c13_enrich_classes",
    lambda t: Y.enrich_classes(_classes(t).select("fqcn", "kind", "annotations"), t("classes").filter("class_no % 2 = 0").select("fqcn", F.array(F.lit("Builder"), F.lit("Slf4j")).alias("annotations"), (F.col("class_no") % 3 == 0).alias("has_builder"))),
    """SELECT fqcn, kind, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN annotation IS NULL THEN [] ELSE ['Slf4j', annotation] END, CASE WHEN class_no % 2 = 0 THEN ['Builder', 'Slf4j'] ELSE [] END))), ',') AS annotations,
              CASE WHEN class_no % 6 = 0 THEN CASE WHEN kind = 'interface' THEN 'mock' ELSE 'builder' END END AS strategy, CASE WHEN class_no % 6 = 0 AND kind = 'interface' THEN 'BUILDER_ON_INTERFACE' END AS reason FROM classes""",
)
add(
    "c14_changed_classes",
    lambda t: Y.changed_classes(t("classes").filter("class_no % 4 = 0").selectExpr("concat(fqcn, '.java') AS path"), t("classes").selectExpr("concat(fqcn, CASE WHEN class_no % 5 = 0 THEN '.md' ELSE '.java' END) AS path", f"{_SOURCE} AS content")),
    """SELECT fqcn || '.java' AS path, 'com.acme.p' || CAST(class_no % 5 AS STRING) || '.Not' AS fqcn FROM classes WHERE class_no % 4 = 0 AND class_no % 5 <> 0""",
)
add("p02_safe_fqcn", lambda t: t("pages").select("page_id", S.safe_fqcn(F.col("url")).alias("safe")), "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS safe FROM pages")
add(
    "p06_decode_descriptor",
    lambda t: t("part").select("p_partkey", S.decode_descriptor(F.element_at(F.array(*[F.lit(x) for x in ("(Ljava/lang/String;[I)V", "()[[Ljava/util/List;", "(JZ[[La/B;)D")]), (F.col("p_size") % 3 + 1).cast("int"))).alias("d")).select("p_partkey", F.array_join("d.params", ",").alias("params"), "d.returns"),
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'java.lang.String,int[]' WHEN 1 THEN '' ELSE 'long,boolean,a.B[][]' END AS params, CASE p_size % 3 WHEN 0 THEN 'void' WHEN 1 THEN 'java.util.List[][]' ELSE 'double' END AS returns FROM part""",
)
add(
    "p14_referenced_types", lambda t: t("classes").select("class_no", F.array_join(S.referenced_types(F.concat(F.lit("java.util.Map<java.lang.String, "), "fqcn", F.lit(">"))), ",").alias("types")),
    "SELECT class_no, 'java.util.Map,' || fqcn AS types FROM classes",
)
#: Every entry of the fixed tables, as a bare, a qualified and an odd name
_TYPES = {**S.DEFAULT_LITERALS, "java.util.List<a.B>": "Collections.emptyList()", "a.b.Odd[]": "new Odd[0]", "odd.T": "null"}
_RAISED = {**S.EXCEPTION_CODES, **{f"a.b.My{name}": code for name, code in S.EXCEPTION_CODES.items()}, "b.Odd": "E_UNKNOWN"}


def _cases(values):
    return " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values))


add(
    "p15_default_literal",
    lambda t: t("part").select("p_partkey", S.default_literal(F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("p_partkey") % len(_TYPES) + 1).cast("int"))).alias("literal")),
    f"SELECT p_partkey, CASE p_partkey % {len(_TYPES)} {_cases(_TYPES.values())} END AS literal FROM part",
)
add(
    "p16_exception_code",
    lambda t: t("part").select("p_partkey", S.exception_code(F.element_at(F.array(*[F.lit(x) for x in _RAISED]), (F.col("p_partkey") % len(_RAISED) + 1).cast("int"))).alias("code")),
    f"SELECT p_partkey, CASE p_partkey % {len(_RAISED)} {_cases(_RAISED.values())} END AS code FROM part",
)
add(
    "p17_lookups", lambda t: t("part").select("p_partkey", S.leading_int(F.concat(F.col("p_size").cast("string"), F.lit(".2.x"))).alias("major"), S.spring_namespace(F.concat((F.col("p_size") % 6).cast("string"), F.lit(".1"))).alias("namespace")),
    "SELECT p_partkey, p_size AS major, CASE WHEN p_size % 6 >= 3 THEN 'jakarta' ELSE 'javax' END AS namespace FROM part",
)
add(
    "p18_normalize_params",
    lambda t: t("part").select("p_partkey", F.array_join(S.normalize_params(F.when(F.col("p_size") % 3 == 0, '["String","int"]').when(F.col("p_size") % 3 == 1, '[{"type":"a.B","name":"x"},{"nme":1}]').otherwise(F.lit(None).cast("string"))), ",").alias("types")),
    "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'String,int' WHEN 1 THEN 'a.B,java.lang.Object' ELSE '' END AS types FROM part",
)
add(
    "p16_suggested_rule", lambda t: t("failure_memory").select("event_id", S.suggested_rule(F.element_at(F.array(*[F.lit(x) for x in ("E_NPE", "E_MOCK_STUB", "E_ODD", "E_SPRING_BEAN")]), (F.col("event_id") % 4 + 1).cast("int")),
                                                                                     F.when(F.col("event_id") % 8 == 2, "package a does not exist").otherwise("x")).alias("rule")),
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'mockito.rules#NULL_RETURN' WHEN 1 THEN 'mockito.rules' WHEN 3 THEN 'spring.rules' ELSE CASE WHEN event_id % 8 = 2 THEN 'imports.rules' END END AS rule FROM failure_memory""",
)
add(
    "p17_classification_bucket", lambda t: t("classification").select("fqcn", S.classification_bucket(F.col("type")).alias("b")).select("fqcn", "b.bucket", "b.subtype"),
    "SELECT fqcn, CASE WHEN type IN ('generated', 'generated/excluded') THEN 'skip' WHEN type = 'controller' THEN 'web' ELSE 'svc' END AS bucket, type AS subtype FROM classification",
)
