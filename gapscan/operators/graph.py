"""Dependency edges, impact of changes, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import scalars as S
from .lineage import cut_lineage, written
from .symbols import best_constructor


EDGE_KINDS = ("uses", "injects", "repositories", "clients", "extends", "implements")


def reverse_edges(index: DataFrame) -> DataFrame:
    """G-1: from used to user, over all kinds; blanks dropped.  ``index``: src and one array
    column a kind."""
    arrays = [F.coalesce(F.col(k), F.array().cast("array<string>")) for k in EDGE_KINDS if k in index.columns]
    rows = index.select(F.col("src").alias("dst"), F.explode(F.concat(*arrays)).alias("src"))
    return rows.filter((F.trim("src") != "") & (F.trim("dst") != "")).select("src", "dst").distinct()


def impact(seeds: DataFrame, reversed_edges: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """G-2: what is reached from the seeds in at most ``impact_depth`` hops, with the hop.
    Each hop joins only the new frontier; it ends when that is empty."""
    reached = cut_lineage(seeds.select(F.col("fqcn").alias("node")).distinct().withColumn("hops", F.lit(0)))
    # written once: no hop works the edges out again; the frontier alone is dealt anew
    edges = cut_lineage(reversed_edges.select(F.col("src").alias("node"), F.col("dst").alias("next")))
    frontier = reached
    for hop in range(1, config.impact_depth + 1):
        new = frontier.join(edges.hint("shuffle_hash"), "node").select(F.col("next").alias("node")).distinct().join(reached.select("node").hint("merge"), "node", "left_anti")
        frontier = cut_lineage(new.withColumn("hops", F.lit(hop)))
        if not frontier.head(1):
            break
        reached = reached.unionByName(frontier)
    return reached


#: Suffixes of types that are mocked, and hints of external clients (fixed values)
MOCKABLE_SUFFIXES = (
    "service", "repository", "dao", "port", "client", "gateway",
    "adapter", "factory", "provider", "handler", "manager",
    "processor", "consumer", "producer", "reader", "writer",
    "store", "cache", "notifier", "publisher", "sender",
)
CLIENT_HINTS = (
    "resttemplate", "webclient", "httpclient", "restclient", "asyncresttemplate",
    "kafkatemplate", "kafkaconsumer", "kafkaproducer",
    "rabbitmqtemplate", "amqptemplate", "jmstemplate",
    "redistemplate", "stringredistemplate", "reactiveredistemplate",
    "s3client", "sqsclient", "snsclient", "dynamodbclient",
    "feignclient", "openfeign",
    "smtpmailer", "javamailer", "mailsender",
    "elasticsearchclient", "restclientbuilder",
)
SLICES = {"RestController": "web", "Controller": "web", "ControllerAdvice": "web", "RestControllerAdvice": "web", "Repository": "data", "Configuration": "context"}


def build_dependencies(members: DataFrame, params: DataFrame, classes: DataFrame) -> DataFrame:
    """G-3: one row for each parameter of a class's best constructor: field name, whether it
    is mocked, whether it is an external client, and the class's test slice.
    ``params``: evidence_id, pos, type."""
    best = best_constructor(members).select(F.col("fqcn").alias("sut"), "evidence_id")
    kinds = classes.select(F.col("fqcn").alias("type"), "kind", "is_abstract").dropDuplicates(["type"])
    slices = classes.select(F.col("fqcn").alias("sut"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SLICES.items() for x in kv]), F.col("annotation")), F.lit("unit")).alias("slice")).dropDuplicates(["sut"])
    simple = S.simple_name(F.col("type"))
    mockable = (
        F.when(~F.col("type").contains(".") | F.col("type").rlike(r"^java\.(lang|util)\."), False).when(F.col("kind").isNotNull(), (F.col("kind") == "interface") | F.col("is_abstract"))
        .otherwise(F.lower(simple).rlike(f"({'|'.join(MOCKABLE_SUFFIXES)})$"))
    )
    rows = best.join(params, "evidence_id").join(kinds, "type", "left").join(slices, "sut", "left")
    return rows.select("sut", "pos", "type", S.camel(F.col("type")).alias("name"), mockable.alias("mockable"), F.lower(simple).rlike("|".join(CLIENT_HINTS)).alias("external_client"), F.coalesce("slice", F.lit("unit")).alias("slice"))


def dependency_index(deps: DataFrame) -> DataFrame:
    """G-4: what each class injects, and which of it are repositories or clients."""
    simple = S.simple_name(F.col("type"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("type")))), ",")
    repository, client = simple.rlike("Repository|Repo|Dao|DAO"), F.lower(simple).rlike("|".join(CLIENT_HINTS))
    return deps.groupBy("sut").agg(listed(F.lit(True)).alias("injects"), listed(~repository & ~client).alias("uses"), listed(repository).alias("repositories"), listed(client).alias("clients"))


def _one_way(edges: DataFrame) -> DataFrame:
    """Where one way out of each node leads, by doubling: ``node, to, least, plain, end``.

    Each node takes its smallest successor, a node without one stays.  When the set of
    goals no longer shrinks, they are all on cycles (or ends), and when no smallest name
    met on the way changes, each node of a cycle has the smallest of its cycle.  ``plain``: no node
    on the way had a choice; ``end``: a node without a way out."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to"), (F.count(F.lit(1)) == 1).alias("plain"), F.lit(False).alias("end"))
    ends = edges.select(F.col("dst").alias("node")).distinct().join(out.select("node").hint("merge"), "node", "left_anti")
    ends = ends.select("node", F.col("node").alias("to"), F.lit(True).alias("plain"), F.lit(True).alias("end"))
    walk = written(out.unionByName(ends).withColumn("least", F.col("node")))
    goals = -1
    while True:
        onward = walk.select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("least").alias("__least"), F.col("plain").alias("__plain"), F.col("end").alias("__end"))
        step = walk.join(onward.hint("merge"), "to")
        walk = written(step.select(
            "node", F.col("__to").alias("to"), F.least("least", "__least").alias("least"), (F.col("plain") & F.col("__plain")).alias("plain"),
            F.col("__end").alias("end"), (F.col("__least") < F.col("least")).alias("__lower"),
        ))
        now, lower = walk.agg(F.count_distinct("to"), F.count_if("__lower")).first()
        if now == goals and not lower:
            return walk.drop("__lower")
        goals = now


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` between groups: names in ``labels (node, label)`` replaced, loops dropped."""
    for end in ("src", "dst"):
        new = labels.select(F.col("node").alias(end), F.col("label").alias("__label")).hint("merge")
        edges = edges.join(new, end, "left").withColumn(end, F.coalesce("__label", end)).drop("__label")
    return edges.filter("src <> dst").select("src", "dst").distinct()


def _coloured(edges: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame] | None:
    """Groups by colour: the smallest name that reaches a node is its colour, and what
    leads back to that name inside a colour is its group.  Gives ``(node, label)`` and the edges
    inside colours, or None where ``rounds`` do not settle it (long ways; they are contracted first)."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colour = written(nodes.withColumn("colour", F.col("node")))
    for _ in range(rounds):
        came = edges.join(colour.select(F.col("node").alias("src"), "colour").hint("merge"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("__came"))
        better = F.col("__came") < F.col("colour")
        colour = written(colour.join(came.hint("merge"), "node", "left").select("node", F.when(better, F.col("__came")).otherwise(F.col("colour")).alias("colour"), better.alias("__new")))
        if not colour.filter("__new").head(1):
            break
        colour = colour.drop("__new")
    else:
        return None
    colour = colour.select("node", "colour")
    within = edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("__s")).hint("merge"), "src")
    within = within.join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("__d")).hint("merge"), "dst").filter("__s = __d")
    within = written(within.select("src", "dst", F.col("__s").alias("colour")))
    found = frontier = written(colour.filter("node = colour"))
    while True:
        back = within.join(frontier.select(F.col("node").alias("dst")).hint("merge"), "dst").select(F.col("src").alias("node"), "colour").distinct()
        frontier = written(back.join(found.select("node").hint("merge"), "node", "left_anti"))
        if not frontier.head(1):
            return found.select("node", F.col("colour").alias("label")), within.select("src", "dst")
        found = found.unionByName(frontier)


def strong_groups(edges: DataFrame, colour_rounds: int = 40) -> DataFrame:
    """``node, group_id, size`` of every strongly connected group of two nodes or more; the
    id is its smallest name.

    Rounds of three steps, each linear in the edges left.  Following one way out of each
    node finds cycles, which become one node, and nodes from which every way is forced to
    an end, which go; the same against the edges; then groups by colours.  Every round
    contracts or drops something, so it ends; long rings and chains fall to the doubling, dense groups to
    the colours."""
    left = written(edges.filter("src <> dst").select("src", "dst").distinct())
    member = written(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("label", F.col("node")))

    def moved(member: DataFrame, labels: DataFrame) -> DataFrame:
        new = labels.select(F.col("node").alias("label"), F.col("label").alias("__label")).hint("merge")
        return written(member.join(new, "label", "left").select("node", F.coalesce("__label", "label").alias("label")))

    while left.head(1):
        for turn in (False, True):
            walk = _one_way(_turned(left) if turn else left)
            goals = walk.filter(~F.col("end")).select(F.col("to").alias("node")).distinct()
            labels = written(walk.join(goals.hint("merge"), "node", "left_semi").select("node", F.col("least").alias("label")))
            dead = walk.filter("end AND plain").select("node")
            for end in ("src", "dst"):
                left = left.join(dead.select(F.col("node").alias(end)).hint("merge"), end, "left_anti")
            left = written(_relabelled(left, labels))
            member = moved(member, labels)
            if not left.head(1):
                break
        else:
            found = _coloured(left, colour_rounds)
            if found is not None:
                labels, inner = found
                left, member = written(_relabelled(inner, labels)), moved(member, labels)
    sizes = member.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("group_id")).filter("size > 1")
    return member.join(sizes.hint("merge"), "label").select("node", "group_id", "size")


def fixture_cycles(edges: DataFrame) -> DataFrame:
    """G-5: nodes on a cycle, with the id (the smallest name) and the size of their group;
    a node that only leads to itself is a group of one."""
    groups = written(strong_groups(edges))
    alone = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().join(groups.hint("merge"), "node", "left_anti")
    return groups.unionByName(alone.select("node", F.col("node").alias("group_id"), F.lit(1).cast("long").alias("size")))


def cycle_partners(cycles: DataFrame) -> DataFrame:
    """``fixture_cycles`` with the other nodes of each node's group, in order.  A group is
    listed once and handed to its nodes."""
    listed = cycles.groupBy("group_id").agg(F.array_sort(F.collect_list("node")).alias("__all"))
    rows = cycles.join(listed.hint("merge"), "group_id")
    return rows.select("node", F.array_join(F.array_remove("__all", F.col("node")), ",").alias("partners"), "group_id", "size")
