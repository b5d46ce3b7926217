"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations.

A source's documents are cut into blocks.  Block j of a source with weight w is
released at slot floor(j / w) and due by slot ceil((j + 1) / w); in each slot the
released block with the earliest deadline goes (ties: the shorter wait to the next
deadline, then the name).  With whole-number weights of sum L the schedule repeats
every L slots, in which a source of w parts gets exactly w of them, so one cycle is
worked out, in one SQL aggregate, and every block's slot follows by arithmetic.  In
any prefix of a full schedule a source is less than one block from its share.

A source that runs out leaves its slots empty and the others go on in their order:
every document is placed once.  Sources without a weight share the class ``other``.

Within a source the order is by hash of the id.  Blocks are numbered without
gathering a source: rows are counted by hash bucket, the counts are summed up, and
only rows of one bucket are sorted together.

Defined cases: null source is class ``other``; null and repeated ids are placed row
by row; an empty table gives no rows; other columns are kept, but for any that bear
the names of the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Target weights in parts of 100.
WEIGHTS = {
    "src0": 20, "src1": 6, "src2": 6, "src3": 6, "src4": 6, "src5": 5, "src6": 5, "src7": 5, "src8": 5, "src9": 5,
    "src10": 3, "src11": 3, "src12": 3, "src13": 3, "src14": 3, "src15": 3, "src16": 3, "src17": 3, "src18": 3, "other": 4,
}
BLOCK = 32


def schedule(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    """One cycle: ``slot``, ``class``, ``nth`` (the class's block in the cycle) and
    ``done`` (blocks of each class before the slot, by class order)."""
    names = sorted(weights)
    total = sum(weights.values())
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers of at least 1")
    parts = F.array(*[F.lit(weights[n]) for n in names])

    def due(part: Column, nth: Column) -> Column:  # ceil((nth + 1) * total / part)
        return F.floor(((nth + 1) * total + part - 1) / part)

    def step(state: Column, slot: Column) -> Column:
        ready = F.transform(
            F.sequence(F.lit(0), F.lit(len(names) - 1)),
            lambda c: F.struct(
                # not yet released, or all blocks of the cycle placed: behind every other
                F.when(
                    (state["done"][c] < parts[c]) & (F.floor(state["done"][c] * total / parts[c]) <= slot),
                    due(parts[c], state["done"][c]),
                ).otherwise(F.lit(2 * total + 1)).cast("long").alias("deadline"),
                due(parts[c], state["done"][c] + 1).cast("long").alias("following"),
                c.alias("class"),
            ),
        )
        taken = F.array_min(ready)["class"]
        return F.struct(
            F.transform(state["done"], lambda d, i: d + (i == taken).cast("int")).alias("done"),
            F.concat(state["out"], F.array(F.struct(slot.alias("slot"), taken.alias("class"), state["done"][taken].alias("nth"), state["done"].alias("done")))).alias("out"),
        )

    kind = "array<struct<slot:int,class:int,nth:int,done:array<int>>>"
    start = F.struct(F.array_repeat(F.lit(0), len(names)).alias("done"), F.array().cast(kind).alias("out"))
    cycle = spark.range(1).select(F.aggregate(F.sequence(F.lit(0), F.lit(total - 1)), start, step)["out"].alias("out"))
    placed = cycle.select(F.explode("out").alias("x")).select("x.*")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("class") + 1)
    return placed.select(F.col("slot").cast("long").alias("slot"), named.alias("class"), F.col("nth").cast("long").alias("nth"), "done")


def _placed(
    docs: DataFrame, weights: dict[str, int] | None = None, *, id_col: str = "doc_id", source_col: str = "source",
    block: int = BLOCK, bucket_rows: int = 20_000,
) -> DataFrame:
    """``docs`` with ``__mix_class``, ``__mix_slot``, ``__mix_position`` and, in every row,
    ``__mix_total``, the number of rows."""
    spark = docs.sparkSession
    weights = dict(weights or WEIGHTS)
    weights.setdefault("other", 1)
    names, total = sorted(weights), sum(weights.values())
    listed = [n for n in names if n != "other"]
    n = docs.count()
    digits = max(1, math.ceil(math.log(max(2, n / bucket_rows, common.shuffle_width(spark)), 16)))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    # rows without an id are told apart by their content, or they would share a bucket
    spread = F.when(F.col(id_col).isNull(), F.md5(F.concat(F.lit("-"), F.xxhash64(*docs.columns).cast("string")).cast("binary"))).otherwise(key)
    base = docs.withColumn("__class", F.when(F.col(source_col).isin(listed), F.col(source_col)).otherwise(F.lit("other")))
    base = base.withColumn("__key", spread).withColumn("__bucket", F.substring("__key", 1, digits))

    counts = base.groupBy("__class", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__class").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__class", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    totals = counts.groupBy("__class").agg(F.sum("__n").alias("n"))  # at most one row a weight
    sizes = totals.agg(F.map_from_entries(F.collect_list(F.struct("__class", "n"))).alias("__sizes"))
    # one row of bounded width: the cycle's slot of every (class, block of the cycle)
    cycle = F.broadcast(schedule(spark, weights).withColumnRenamed("class", "__class"))

    order = Window.partitionBy("__class", "__bucket").orderBy("__key", id_col)
    ranked = base.withColumn("__rank", F.row_number().over(order) - 1)
    numbered = ranked.join(offsets.hint("shuffle_hash"), ["__class", "__bucket"]).withColumn("__i", F.col("__rank") + F.col("__before"))
    parts = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(weights[c]))])
    blocked = numbered.withColumn("__b", F.floor(F.col("__i") / block)).withColumn("__w", parts[F.col("__class")])
    blocked = blocked.withColumn("__nth", F.col("__b") % F.col("__w")).withColumn("__turn", F.floor(F.col("__b") / F.col("__w")))
    placed = blocked.join(cycle.withColumnRenamed("nth", "__nth").withColumnRenamed("slot", "__at").withColumnRenamed("done", "__done"), ["__class", "__nth"])
    placed = placed.join(F.broadcast(sizes), F.lit(True))  # the one row of class sizes
    # rows of class c in earlier slots: whole blocks, as far as the class has rows
    earlier = [
        F.least(F.coalesce(F.col("__sizes")[c], F.lit(0)), block * (F.col("__turn") * weights[c] + F.col("__done")[i]))
        for i, c in enumerate(names)
    ]
    position = sum(earlier[1:], earlier[0]) + F.col("__i") % block
    return placed.select(
        *docs.columns,
        F.col("__class").alias("__mix_class"),
        (F.col("__turn") * total + F.col("__at")).alias("__mix_slot"),
        position.cast("long").alias("__mix_position"),
        F.aggregate(F.map_values("__sizes"), F.lit(0).cast("long"), lambda a, x: a + x).alias("__mix_total"),
    )


def mix(docs: DataFrame, weights: dict[str, int] | None = None, **options) -> DataFrame:
    """``docs`` with ``mix_class``, ``mix_slot`` and ``mix_position``, the row's place in
    the mixture, dense from 0; columns of these names are replaced.  Options: ``id_col``,
    ``source_col``, ``block`` (rows a block), ``bucket_rows`` (rows sorted together)."""
    added = ("mix_class", "mix_slot", "mix_position")
    kept = [c for c in docs.columns if c not in added]
    return _placed(docs, weights, **options).select(*kept, *[F.col(f"__{c}").alias(c) for c in added])


def mixed_order(docs: DataFrame, weights: dict[str, int] | None = None, **options) -> DataFrame:
    """``docs`` in the order of the mixture, with their own columns: row ranges of the
    mixture are partitions, sorted within.  Positions are dense, so ranges follow by
    arithmetic: no run of the plan to sample them."""
    width, at = common.shuffle_width(docs.sparkSession), F.col("__mix_position")
    part = F.floor(at * width / F.col("__mix_total")).cast("int")
    return _placed(docs, weights, **options).repartitionById(width, part).sortWithinPartitions(at).select(*docs.columns)


def reference_cycle(weights: dict[str, int]) -> list[tuple[int, str, int]]:
    """The same cycle as a plain loop, for the SQL twin: (slot, class, nth)."""
    names, total = sorted(weights), sum(weights.values())
    done, out = dict.fromkeys(names, 0), []
    for slot in range(total):
        ready = [c for c in names if done[c] < weights[c] and done[c] * total // weights[c] <= slot]
        taken = min(ready, key=lambda c: (-(-(done[c] + 1) * total // weights[c]), -(-(done[c] + 2) * total // weights[c]), c))
        out.append((slot, taken, done[taken]))
        done[taken] += 1
    return out


def oracle_sql(weights: dict[str, int] | None = None, block: int = BLOCK) -> str:
    """DuckDB SQL for ``doc_id, source, mix_class, mix_slot, mix_position``."""
    weights = dict(weights or WEIGHTS)
    weights.setdefault("other", 1)
    total = sum(weights.values())
    cycle = ", ".join(f"({s}, '{c}', {n})" for s, c, n in reference_cycle(weights))
    parts = ", ".join(f"('{c}', {w})" for c, w in sorted(weights.items()))
    listed = ", ".join(f"'{c}'" for c in sorted(weights) if c != "other")
    return f"""
        WITH cycle(place, class, nth) AS (VALUES {cycle}), parts(class, w) AS (VALUES {parts}),
        base AS (
            SELECT doc_id, source, CASE WHEN source IN ({listed}) THEN source ELSE 'other' END AS class FROM documents
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i FROM base
        ), placed AS (
            SELECT doc_id, source, class, i, (i // {block}) // w * {total} + place AS slot
            FROM numbered JOIN parts USING (class) JOIN cycle USING (class)
            WHERE nth = (i // {block}) % w
        )
        SELECT doc_id, source, class AS mix_class, CAST(slot AS BIGINT) AS mix_slot,
               CAST(row_number() OVER (ORDER BY slot, i) - 1 AS BIGINT) AS mix_position
        FROM placed
    """
