"""Classes and members: indexes, classification, fixtures, allowed imports, packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import scalars as S
from ..functions.java_calls import read_calls
from .lineage import importable, written
from .planning import dotted_prefixes, targets_by_class

#: Annotation to class type (fixed values)
ANNOTATION_TYPES = {
    "restcontroller": "controller", "controller": "controller", "controlleradvice": "controller", "restcontrolleradvice": "controller", "feignclient": "controller",
    "service": "service",
    "repository": "repository", "repositoryrestresource": "repository",
    "configuration": "configuration", "springbootapplication": "configuration", "enablewebmvc": "configuration", "enablewebflux": "configuration",
    "mapper": "mapper", "mapperconfig": "mapper",
    "component": "component",
}
#: Name suffixes to class type, in this order (fixed values)
SUFFIX_TYPES = [
    (("controller", "resource", "endpoint", "rest"), "controller"),
    (("service", "serviceimpl", "servicefacade"), "service"),
    (("repository", "repositoryimpl", "repo", "dao", "daoimpl"), "repository"),
    (("mapper", "mapperimpl", "converter", "converterimpl"), "mapper"),
    (("config", "configuration", "settings", "properties"), "configuration"),
    (("exception", "error", "fault"), "exception"),
    (("dto", "request", "response", "vo", "payload", "command"), "data-carrier"),
    (("util", "utils", "helper", "helpers", "factory", "builder"), "util"),
    (("entity", "model", "domain"), "entity"),
]
#: Class type to testability risk, coverage value and test template (fixed values)
TYPE_FACTS = {
    "generated": ("high", "low", None),
    "non-instantiable": ("high", "low", None),
    "configuration": ("high", "low", None),
    "controller": ("medium", "high", "templates/webmvc-test.java"),
    "component": ("low", "medium", "templates/junit5-mockito.java"),
    "service": ("low", "high", "templates/junit5-mockito.java"),
    "repository": ("low", "medium", "templates/junit5-mockito.java"),
    "mapper": ("low", "medium", "templates/junit5-mockito.java"),
    "data-carrier": ("low", "low", "templates/junit5-mockito.java"),
    "enum": ("low", "low", "templates/junit5-mockito.java"),
    "entity": ("low", "low", "templates/junit5-mockito.java"),
    "exception": ("low", "low", "templates/junit5-mockito.java"),
    "util": ("low", "medium", "templates/junit5-mockito.java"),
}


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def classify_classes(classes: DataFrame, generated: DataFrame) -> DataFrame:
    """C-1: the type of each class by ordered evidence, and what follows from it.
    ``classes``: fqcn, kind, is_abstract, annotations array; ``generated``: fqcn."""
    names = F.transform("annotations", lambda a: F.lower(a))
    hit = F.transform(names, lambda a: F.try_element_at(_table(ANNOTATION_TYPES), a))
    by_annotation = F.get(F.array_compact(hit), 0)
    simple = F.lower(S.simple_name(F.col("fqcn")))
    by_suffix = F.lit(None).cast("string")
    for suffixes, kind in reversed(SUFFIX_TYPES):
        by_suffix = F.when(simple.rlike(f"({'|'.join(suffixes)})$"), kind).otherwise(by_suffix)
    gen = generated.select("fqcn", F.lit(True).alias("__gen")).distinct()
    steps = [
        ("generated", F.when(F.col("__gen"), "generated")),
        ("annotation", by_annotation),
        ("abstract", F.when((F.col("kind") == "interface") | F.col("is_abstract"), "non-instantiable")),
        ("record", F.when(F.col("kind") == "record", "data-carrier")),
        ("enum", F.when(F.col("kind") == "enum", "enum")),
        ("suffix", by_suffix),
        ("default", F.lit("component")),
    ]
    picked = F.coalesce(*[F.when(t.isNotNull(), F.struct(t.alias("type"), F.lit(n).alias("reason"))) for n, t in steps])
    rows = classes.join(gen, "fqcn", "left").withColumn("__p", picked)
    fact = lambda i: F.element_at(_table({k: v[i] for k, v in TYPE_FACTS.items() if v[i]}), F.col("__p.type"))
    template = F.try_element_at(_table({k: v[2] for k, v in TYPE_FACTS.items() if v[2]}), F.col("__p.type"))
    return rows.select("fqcn", F.col("__p.type").alias("type"), fact(0).alias("testability_risk"), fact(1).alias("coverage_value"), template.alias("template"), F.col("__p.reason").alias("reason"))


def annotation_index(members: DataFrame, classes: DataFrame) -> DataFrame:
    """A-11: annotations of each class, and of each class#method, from both tables."""
    own = classes.select(F.col("fqcn").alias("key"), "annotation")
    of_class = members.select(F.col("fqcn").alias("key"), "annotation")
    of_method = members.select(F.concat("fqcn", F.lit("#"), "name").alias("key"), "annotation")
    rows = own.unionByName(of_class).unionByName(of_method).filter(F.col("annotation").isNotNull())
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("annotation")), ",").alias("annotations"))


def member_index(members: DataFrame) -> DataFrame:
    """A-12: constructors, usable methods and builders of each class in order; a class
    without any is absent."""
    usable = members.filter((F.col("kind") != "method") | (F.coalesce("usable", F.lit(True)) & ~F.col("name").startswith("<")))
    line = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "name")))), lambda x: x["name"]), ",")
    return usable.groupBy("fqcn").agg(line("constructor").alias("constructors"), line("method").alias("methods"), line("builder").alias("builders"), F.count(F.lit(1)).alias("total"))


def best_constructor(members: DataFrame, public_only: bool = False) -> DataFrame:
    """W-3: public before package, fewest parameters, first on ties."""
    ranks = {"public": 0} if public_only else {"public": 0, "package": 1}
    rank = F.try_element_at(_table(ranks), F.col("visibility"))
    made = members.filter("kind = 'constructor'").withColumn("__rank", rank).filter(F.col("__rank").isNotNull())
    best = made.groupBy("fqcn").agg(F.min_by(F.struct("name", "visibility", "n_params", "pos", "evidence_id"), F.struct("__rank", "n_params", "pos")).alias("b"))
    return best.select("fqcn", "b.*")


#: Scenarios to test of a class type; other types have the default (fixed values)
VARIANTS = {
    "controller": ("valid-request", "invalid-request", "not-found", "unauthorized"),
    "service": ("happy-path", "not-found", "validation-error", "dependency-failure"),
    "repository": ("find-found", "find-not-found", "save-success", "delete-success"),
    "component": ("happy-path", "error-case"),
    "mapper": ("valid-mapping", "null-input"),
    "data-carrier": ("default-values", "full-values"),
    "enum": ("all-values",),
    "non-instantiable": (),
    "generated/excluded": (),
    "configuration": (),
}
DEFAULT_VARIANTS = ("happy-path",)


def build_fixtures(members: DataFrame, classes: DataFrame, with_mocks: bool = True) -> DataFrame:
    """C-2: how to make an instance of each class: builder, public constructor, static
    method that returns the class, mock; a mock of what is neither an interface nor
    abstract is degraded.  Interfaces and abstract classes are only ever mocked.
    ``members``: also entry (of a builder; a generated ``X_Builder`` is none), build,
    is_static, return_type.  ``variants`` are the scenarios of the class's ``type``, where
    ``classes`` has one; a degraded mock has none."""
    entry, made = F.col("entry"), lambda name, evidence: F.struct(F.lit(name).alias("strategy"), evidence.alias("evidence"))
    is_builder = (F.col("kind") == "builder") & (entry.contains(".Builder") | (entry.endswith("Builder()") & ~entry.contains("_Builder")))
    returned = S.simple_name(F.col("return_type")) == S.simple_name(F.col("fqcn"))
    is_factory = (F.col("kind") == "method") & F.col("is_static") & returned
    # what picks nothing goes, and rows meet by class first: a sort before the shuffle would hold all that a split multiplies into
    open_ = (F.col("kind") == "constructor") & (F.col("visibility") == "public")
    members = members.filter(is_builder | is_factory | open_).repartition("fqcn")
    picks = members.groupBy("fqcn").agg(
        F.min_by(made("builder", F.concat_ws(" … ", entry, F.coalesce("build", F.lit("build()")))), F.when(is_builder, F.col("pos"))).alias("b"),
        F.min_by(made("factory", F.col("evidence_id")), F.when(is_factory, F.col("pos"))).alias("f"),
    )
    ctor = best_constructor(members, public_only=True).select("fqcn", made("constructor", F.col("evidence_id")).alias("c"))
    abstract = (F.col("kind") == "interface") | F.col("is_abstract")
    rows = classes.join(picks.hint("merge"), "fqcn", "left").join(ctor.hint("merge"), "fqcn", "left")
    concrete = F.coalesce("b", F.when(F.col("kind") != "annotation", F.col("c")), "f")
    chosen = F.coalesce(F.when(~abstract, concrete), made("mock", F.lit(None).cast("string")))
    degraded = (F.col("__x.strategy") == "mock") & ~(abstract & F.lit(with_mocks))
    by_type = F.create_map(*[x for k, v in VARIANTS.items() for x in (F.lit(k), F.lit(",".join(v)))])
    kept = F.col("type") if "type" in classes.columns else F.lit(None).cast("string")
    variants = F.when(degraded, "").otherwise(F.coalesce(F.try_element_at(by_type, kept), F.lit(",".join(DEFAULT_VARIANTS))))
    return rows.withColumn("__x", chosen).select("fqcn", "__x.strategy", "__x.evidence", degraded.alias("degraded"), variants.alias("variants"))


def fixture_values(params: DataFrame, literals: dict[str, str] | None = None) -> DataFrame:
    """C-2 values: a default literal for each parameter of a constructor, as a map."""
    entry = F.struct("pos", F.concat(F.lit("arg"), F.col("pos").cast("string")).alias("name"), S.default_literal(F.col("type"), literals).alias("value"))
    listed = F.array_sort(F.collect_list(entry))
    return params.groupBy("fqcn").agg(F.map_from_entries(F.transform(listed, lambda x: F.struct(x["name"], x["value"]))).alias("values"))


def dictionary_encode(ids: DataFrame, group: str, col: str, pos: str) -> DataFrame:
    """W-10: number the values of a group by first appearance."""
    first = ids.groupBy(group, col).agg(F.min(pos).alias("__first"))
    return first.select(group, col, (F.row_number().over(Window.partitionBy(group).orderBy("__first", col)) - 1).alias("code"))


def compact_imports(imports: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """P-20: the first imports of each class, packages with enough leaves factored out,
    the rest under ``_``."""
    nth = F.row_number().over(Window.partitionBy("fqcn").orderBy("pos"))
    kept = imports.withColumn("__n", nth).filter(F.col("__n") <= config.import_cap).withColumn("__p", S.package_of(F.col("import")))
    many = F.count(F.lit(1)).over(Window.partitionBy("fqcn", "__p")) >= config.factor_from
    keyed = kept.withColumn("prefix", F.when(many, F.col("__p")).otherwise("_")).withColumn("leaf", F.when(many, S.simple_name(F.col("import"))).otherwise(F.col("import")))
    leaves = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "leaf"))), lambda x: x["leaf"]), ",")
    return keyed.groupBy("fqcn", "prefix").agg(leaves.alias("leaves"))


def expand_imports(compact: DataFrame) -> DataFrame:
    """The inverse of ``compact_imports``, but for order."""
    leaf = compact.select("fqcn", "prefix", F.explode(F.split("leaves", ",")).alias("leaf"))
    return leaf.select("fqcn", F.when(F.col("prefix") == "_", F.col("leaf")).otherwise(F.concat("prefix", F.lit("."), "leaf")).alias("import"))


def resolve_type(uses: DataFrame, imports: DataFrame, classes: DataFrame) -> DataFrame:
    """J-17: a type name by exact name, import, same package, or any simple name (the
    smallest).  ``uses``: file, package, name."""
    exact = classes.select(F.col("fqcn").alias("name"), F.col("fqcn").alias("__exact")).distinct()
    by_import = imports.groupBy("file", S.simple_name(F.col("import")).alias("name")).agg(F.min("import").alias("__import"))
    by_package = classes.select(F.col("fqcn").alias("__local")).distinct()
    anywhere = classes.groupBy(S.simple_name(F.col("fqcn")).alias("name")).agg(F.min("fqcn").alias("__any"))
    rows = uses.withColumn("__want", F.concat("package", F.lit("."), "name"))
    for part, keys in ((exact, ["name"]), (anywhere, ["name"]), (by_import, ["file", "name"]), (by_package.withColumnRenamed("__local", "__want").withColumn("__local", F.col("__want")), ["__want"])):
        rows = rows.join(part.hint("shuffle_hash"), keys, "left")
    return rows.select(*uses.columns, F.coalesce("__exact", "__import", "__local", "__any").alias("resolved"))


def collaborator_usage(deps: DataFrame, members: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """J-12: the first public members of each dependency's type.  Members are cut to the
    first few of a type before they are joined."""
    nth = F.row_number().over(Window.partitionBy("fqcn").orderBy("pos"))
    public = members.filter("visibility = 'public' AND kind = 'method'").withColumn("__n", nth).filter(F.col("__n") <= config.collaborator_methods)
    listed = public.groupBy(F.col("fqcn").alias("type")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "name"))), lambda x: x["name"]), ",").alias("methods"))
    return deps.select("sut", "type").distinct().join(listed, "type").select("sut", "type", "methods")


def dependency_strategy(deps: DataFrame, fixtures: DataFrame) -> DataFrame:
    """J-13: how to supply each dependency; a mock by default."""
    known = fixtures.groupBy(F.col("fqcn").alias("type")).agg(F.min("strategy").alias("strategy"))
    return deps.join(known, "type", "left").withColumn("strategy", F.coalesce("strategy", F.lit("mock")))


def class_supply(deps: DataFrame, fixtures: DataFrame) -> DataFrame:
    """J-13 a class: its dependencies in order and how to supply each.  A class's types are
    gathered once; they go to the fixtures, and only what is no mock comes back."""
    own = deps.filter("sut IS NOT NULL").groupBy("sut").agg(F.collect_set("type").alias("types"))  # read twice, shuffled once
    known = fixtures.groupBy(F.col("fqcn").alias("type")).agg(F.min("strategy").alias("strategy")).filter("strategy <> 'mock'")
    found = own.select("sut", F.explode("types").alias("type")).join(known.hint("merge"), "type").repartition("sut")  # no arrays of one before the shuffle
    found = found.groupBy("sut").agg(F.collect_list(F.struct("type", "strategy")).alias("found"))
    found_, mock = F.coalesce("found", F.array().cast("array<struct<type:string,strategy:string>>")), F.lit("mock").alias("strategy")
    mocks = F.transform(F.array_except("types", found_["type"]), lambda x: F.struct(x.alias("type"), mock))
    return own.join(found, "sut", "left").select("sut", F.array_sort(F.concat(found_, mocks)).alias("uses"))


def _thrown() -> Column:
    """Whether what a member throws has to be imported; classes of ``java.lang`` have not."""
    return F.col("throws").isNotNull() & ~F.col("throws").rlike(r"^java\.lang\.[A-Z]\w*$")


def _local_classes(whitelist: DataFrame) -> DataFrame:
    return whitelist.filter("level = 'class'").groupBy(S.package_of(F.col("name")).alias("__p")).agg(F.collect_set("name").alias("__local"))


def _import_list(fqcn: str, presets: tuple[str, ...], *more: Column | str) -> Column:
    none = F.array().cast("array<string>")
    every = F.concat(F.array(fqcn, *[F.lit(p) for p in presets]), *[F.coalesce(m, none) for m in more])
    return F.array_join(F.array_sort(F.array_distinct(every)), ",")


def allowed_imports(classes: DataFrame, members: DataFrame, deps: DataFrame, whitelist: DataFrame, presets: tuple[str, ...]) -> DataFrame:
    """A-22: what a test of each class may import: itself, its dependencies, types its
    members throw, whitelisted classes of its package, and the framework's own."""
    rows = deps.select(F.col("sut").alias("fqcn"), F.col("type").alias("import")).unionByName(members.filter(_thrown()).select("fqcn", F.col("throws").alias("import")))
    own = rows.groupBy("fqcn").agg(F.collect_set("import").alias("__own"))
    # a class moves once: what all classes have is no row of its own, and packages of a whitelist
    # kept by hand are looked up after it
    known = classes.select("fqcn").distinct().join(own.hint("shuffle_hash"), "fqcn", "left").withColumn("__p", S.package_of(F.col("fqcn")))
    known = known.join(F.broadcast(_local_classes(whitelist)), "__p", "left")
    return known.select("fqcn", _import_list("fqcn", presets, "__own", "__local").alias("imports"))


def thrown_exceptions(members: DataFrame) -> DataFrame:
    """A-23: what a class throws, in order of first appearance."""
    first = members.filter(F.col("throws").isNotNull()).groupBy("fqcn", "throws").agg(F.min("pos").alias("pos"))
    return first.groupBy("fqcn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "throws"))), lambda x: x["throws"]), ",").alias("throws"))


def _lines(items: Column) -> Column:
    """The ``line`` of each item, in order."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["line"]), ";")


def _member_lines() -> Column:
    return _lines(F.collect_list(F.struct("pos", F.concat_ws(":", "kind", "name").alias("line")))).alias("members")


def context_pack(plan: DataFrame, classification: DataFrame, coverage: DataFrame, members: DataFrame, deps: DataFrame, fixtures: DataFrame, imports: DataFrame, digest: DataFrame) -> DataFrame:
    """J-16: one row a planned class with all a test writer needs, each part grouped before
    the joins; ``pack_tokens`` by the packed text's bytes."""
    listed = members.groupBy(F.col("fqcn").alias("sut")).agg(_member_lines())
    rows = targets_by_class(plan).join(listed, "sut", "left").join(class_supply(deps, fixtures), "sut", "left").join(imports.withColumnRenamed("fqcn", "sut"), "sut", "left")
    return _packed(rows, classification, coverage, digest)


def context_pack_by_class(targets: DataFrame, classification: DataFrame, coverage: DataFrame, members: DataFrame, supply: DataFrame, classes: DataFrame, whitelist: DataFrame, presets: tuple[str, ...], digest: DataFrame) -> DataFrame:
    """J-16 with the imports of A-22, from targets and dependencies that are a row a class
    already (``plan_by_class``, ``class_supply``): each moves once, for all that is told from it."""
    listed = members.groupBy(F.col("fqcn").alias("sut")).agg(_member_lines(), F.collect_set(F.when(_thrown(), F.col("throws"))).alias("__thrown"))
    known = classes.select(F.col("fqcn").alias("sut")).distinct().withColumn("__known", F.lit(True))
    rows = targets.join(listed, "sut", "left").join(supply, "sut", "left").join(known, "sut", "left")
    rows = rows.withColumn("__p", S.package_of(F.col("sut"))).join(F.broadcast(_local_classes(whitelist)), "__p", "left")
    rows = rows.withColumn("imports", F.when(F.col("__known"), _import_list("sut", presets, F.col("uses")["type"], "__thrown", "__local")))
    return _packed(rows, classification, coverage, digest)


def _packed(rows: DataFrame, classification: DataFrame, coverage: DataFrame, digest: DataFrame) -> DataFrame:
    """``rows``: sut, targets, members, uses, imports; the last three may be null."""
    facts = classification.groupBy(F.col("fqcn").alias("sut")).agg(F.max("type").alias("type"), F.max("template").alias("template"))
    covered = coverage.groupBy(F.col("fqcn").alias("sut")).agg(F.sum("covered_lines").alias("covered_lines"))
    failures = digest.groupBy("sut").agg(_lines(F.collect_list(F.struct("place", F.concat_ws(":", "error_code", "fix_id").alias("line")))).alias("failures"))
    rows = rows.withColumn("dependencies", F.array_join(F.transform("uses", lambda x: F.concat_ws(":", x["type"], x["strategy"])), ";"))
    rows = rows.join(facts, "sut", "left").join(covered, "sut", "left").join(failures, "sut", "left")
    texts = ("imports", "targets", "members", "dependencies", "failures")
    rows = rows.select("sut", "type", "template", "covered_lines", *[F.coalesce(c, F.lit("")).alias(c) for c in texts])
    return rows.withColumn("pack_tokens", S.pack_tokens(F.octet_length(F.concat_ws("\n", "sut", *texts))))


#: Names that ``affected_tests`` answers by a broadcast; a name beyond them has at most a thousandth of the rows
COMMON_NAMES = 1000


def affected_tests(imports: DataFrame, edges: DataFrame, affected: DataFrame) -> DataFrame:
    """J-11: tests that import an affected class or a member of one, or depend on it.  A
    prefix match made equi: every dotted prefix of an import is looked up.
    ``imports``: test, import; ``edges``: src, dst."""
    known = affected.select(F.col("fqcn").alias("name")).distinct()
    prefixes = imports.select("test", F.explode(dotted_prefixes(F.col("import"))).alias("name"))
    depends = edges.select(F.col("src").alias("test"), F.col("dst").alias("name"))
    rows = prefixes.unionByName(depends)
    # ``com`` begins nearly every import: the commonest names, counted where they stand, are answered
    # without a shuffle, so that none of them is gathered in a task
    common = rows.groupBy("name").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "name").limit(COMMON_NAMES)
    common = common.select("name").join(known.withColumn("__known", F.lit(True)).hint("shuffle_hash"), "name", "left").select("name", F.coalesce("__known", F.lit(False)).alias("__known"))
    marked = rows.join(F.broadcast(common), "name", "left")
    rare = marked.filter("__known IS NULL").select("test", "name").join(known.hint("merge"), "name", "left_semi")
    return marked.filter("__known").select("test").unionByName(rare.select("test")).distinct()


#: Calls that any receiver has, methods of every throwable, and owners of the test frameworks (fixed values)
COMMON_CALLS = ("toString", "equals", "hashCode", "getClass", "size", "isEmpty", "contains", "add", "put", "get", "orElse", "orElseThrow")
THROWABLE_CALLS = ("getMessage", "getCause", "toString")
FRAMEWORK_OWNERS = ("Mockito", "Assertions", "Assert", "Collections", "Arrays", "Optional")


def extract_calls(files: DataFrame, classes: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """C-9 and J-17: instantiations and calls of each file, their types resolved among
    ``classes`` (null where none fits).  Returns file, pos, kind, type, method, receiver, fqcn."""
    importable(files.sparkSession)
    read = written(read_calls(files, path, content))  # uses and imports are told from one scan
    simple = lambda u: F.when(u["type"].rlike(r"^[A-Z]"), S.simple_name(u["type"])).otherwise(u["type"])
    named = F.transform("uses", lambda u: F.struct(simple(u).alias("name"), u.alias("u")))
    read = read.select("file", "package", "imports", named.alias("uses"))
    names = F.array_distinct(F.transform("uses", lambda x: x["name"]))
    # a name is looked up once a file, with its uses in an array
    uses = read.select("file", "package", "uses", F.explode(names).alias("name")).select("file", "package", "name", F.transform(F.filter("uses", lambda x: x["name"] == F.col("name")), lambda x: x["u"]).alias("uses"))
    known = classes.select(F.col("fqcn").alias("import")).distinct()
    imports = read.select("file", F.explode("imports").alias("import")).join(known.hint("shuffle_hash"), "import", "left_semi")
    found = resolve_type(uses, imports, classes)
    return found.select("file", F.inline("uses"), F.col("resolved").alias("fqcn"))


def lint_symbols(calls: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """C-9: calls and instantiations that the contract of their type does not know.  Types
    without a contract are left to the compiler.  ``calls``: as from ``extract_calls``;
    ``members``: its ``entry`` and ``build`` columns, where there are any, verify builders
    and name their last call.  Methods of throwables are exempt on types named so."""
    usable = members.filter(F.coalesce("usable", F.lit(True)))
    has = lambda c: F.col(c) if c in members.columns else F.lit(None).cast("string")
    last = F.substring_index(F.coalesce(has("build"), F.lit("build()")), "(", 1)
    names = F.when(F.col("kind") == "builder", F.array("name", last)).otherwise(F.array("name"))
    named = usable.filter("kind IN ('method', 'builder')").select(F.col("fqcn"), F.explode(names).alias("method")).distinct().withColumn("__m", F.lit(True))
    open_ = (F.col("kind") == "constructor") & (F.col("visibility") != "private")
    entry = (F.col("kind") == "builder") & F.coalesce(has("entry").contains(".Builder()"), F.lit("entry" not in members.columns))
    made = usable.groupBy("fqcn").agg(F.bool_or(open_).alias("__new"), F.bool_or(entry).alias("__builder"))
    contract = classes.groupBy("fqcn").agg(F.bool_or(F.col("kind").isin("interface", "annotation") | F.col("is_abstract")).alias("__abstract"))
    kind, method = F.col("kind"), F.col("method")
    unknown = F.col("__m").isNull()
    exempt = method.isin(*COMMON_CALLS) | (method.isin(*THROWABLE_CALLS) & F.col("fqcn").rlike("(Exception|Error)$"))
    fault = (
        F.when(kind == "generated", "DIRECT_GENERATED_BUILDER_FORBIDDEN")
        .when(F.col("__abstract").isNull(), None)
        .when((kind == "builder") & ~F.coalesce("__builder", F.lit(False)), "BUILDER_NOT_VERIFIED")
        .when((kind == "new") & (F.col("__abstract") | ~F.coalesce("__new", F.lit(False))), "INSTANTIATION_NOT_ALLOWED")
        .when((kind == "call") & unknown & ~exempt, "METHOD_NOT_IN_CONTRACT")
        .when((kind == "static") & unknown & ~F.col("type").isin(*FRAMEWORK_OWNERS), "STATIC_METHOD_NOT_IN_CONTRACT")
    )
    rows = calls
    for part, keys in ((contract, ["fqcn"]), (made, ["fqcn"]), (named, ["fqcn", "method"])):
        rows = rows.join(part.hint("shuffle_hash"), keys, "left")
    return rows.withColumn("fault", fault).filter(F.col("fault").isNotNull()).select(*calls.columns, "fault")


def source_types(files: DataFrame) -> DataFrame:
    """C-12: types declared in each file, in order, with kind, annotations and builder
    flag.  ``files``: path, content."""
    pattern = r"((?:@[A-Z]\w*(?:\([^)]*\))?\s+)*)(?:public |protected |private |abstract |final |static |sealed )*\b(class|interface|enum|record)\s+([A-Z]\w*)"
    code = S.strip_noise(F.col("content"))
    rows = files.select("path", code.alias("__code"), F.regexp_extract("content", r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"))
    found = rows.select("path", "package", F.posexplode(F.arrays_zip(*[F.regexp_extract_all("__code", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "a"), (2, "kind"), (3, "name"))])).alias("pos", "x"))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("x.a", F.lit(r"@([A-Z]\w*)"), F.lit(1))))
    return found.select(
        "path", "pos", F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), F.col("x.name")).alias("fqcn"), F.col("x.kind").alias("kind"),
        names.alias("annotations"), F.exists(names, lambda a: a.isin("Builder", "SuperBuilder")).alias("has_builder"),
    )


#: Methods of a builder that set nothing (fixed values)
NO_SETTERS = ("build", "clear", "mergeFrom")


def builder_setters(files: DataFrame) -> DataFrame:
    """C-12: fluent setters, that is one-argument methods that return a builder, once for
    each name and type, in order.  ``files``: path, content."""
    declared = r"(?<![\w.])(?:[A-Za-z_]\w*\.)*Builder\s+([A-Za-z_]\w*)\s*\(\s*([A-Za-z_][^(){};]*?)\s+[A-Za-z_]\w*\s*\)"
    code = S.strip_noise(F.col("content"))
    parts = F.arrays_zip(*[F.regexp_extract_all("__code", F.lit(declared), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "type"))])
    found = files.select("path", code.alias("__code")).select("path", F.posexplode(parts).alias("pos", "x"))
    rows = found.select("path", "pos", F.col("x.name").alias("name"), F.regexp_replace("x.type", r"\s+", " ").alias("type"))
    setters = rows.filter(~F.col("name").isin(*NO_SETTERS) & ~F.col("name").startswith("map"))
    return setters.groupBy("path", "name", "type").agg(F.min("pos").alias("pos"))


def enrich_classes(classes: DataFrame, types: DataFrame) -> DataFrame:
    """C-13: annotations from sources added; a builder on an interface makes it a mock."""
    own = types.select("fqcn", F.col("annotations").alias("__a"), "has_builder")
    rows = classes.join(own, "fqcn", "left")
    strategy = F.when(F.col("has_builder") & (F.col("kind") == "interface"), "mock").when(F.col("has_builder"), "builder")
    both = F.array_sort(F.array_union("annotations", F.coalesce("__a", F.array().cast("array<string>"))))
    reason = F.when(F.col("has_builder") & (F.col("kind") == "interface"), "BUILDER_ON_INTERFACE")
    return rows.select("fqcn", "kind", F.array_join(both, ",").alias("annotations"), strategy.alias("strategy"), reason.alias("reason"))


def changed_classes(changed: DataFrame, sources: DataFrame, suffixes: tuple[str, ...] = (".java", ".kt")) -> DataFrame:
    """C-14: classes of changed source files, by package and first type name."""
    relevant = F.lit(False)
    for s in suffixes:
        relevant = relevant | F.col("path").endswith(s)
    files = sources.join(changed.select("path").distinct(), "path", "left_semi").filter(relevant)
    package = F.regexp_extract("content", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    name = F.regexp_extract("content", r"\b(?:class|interface|enum|record)\s+([A-Z]\w*)", 1)
    return files.select("path", F.concat_ws(".", F.when(package != "", package), name).alias("fqcn"), (name != "").alias("__ok")).filter("__ok").drop("__ok")
