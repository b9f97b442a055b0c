"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a stream of its documents in a shuffled order, cut into blocks
of equal length, small ones into smaller blocks. Its target fixes how many slots
it has; the last one may take a part of its block, so that the target is met to
the word. Slot ``j`` of the mix has the point ``frac(j * golden ratio)``; mapping
the points through the cumulative slots gives each slot a source, evenly at every
stretch of the mix. The slots of a source, ranked, take its blocks in turn,
beginning again after the last one. Where the points give a source fewer slots
than it has, those missing follow at the end; those too many stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, partitions, staged

WEIGHTS = (5.0, 2.0, 1.0)
GOLDEN = 0.6180339887498949
#: The mix has about this many slots, and those of small sources besides; a block
#: has this many words at least, and a source this many blocks where they allow it.
SLOTS = 1 << 20
LEAST_BLOCK = 16
SOURCE_BLOCKS = 64
#: Slots per chunk when slots are ranked, and cells of the scale of weights.
CHUNK = 4096
CELLS = 4096


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, size) to (source, source_size, target): ``share`` of all sizes
    by weight, none over ``cap`` times its size, the excess reshared by weight.

    That is a water level: ``target = min(weight * level, cap * size)``. Sorted
    by ``cap * size / weight``, the sources at their caps come first, so the
    level follows from running sums. One row per source is all that is sorted.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*map(F.lit, weights))
    named = sizes.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    up_to = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = named.withColumn("fill", cap * F.col("size") / F.col("weight")).select(
        "source", "size", "weight", "fill",
        F.coalesce(F.sum(cap * F.col("size")).over(up_to), F.lit(0.0)).alias("capped"),
        F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)).alias("passed"),
        F.sum("weight").over(every).alias("weights"),
        (share * F.sum("size").over(every)).alias("total"),
    )
    level = level.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("passed")))
    # The first source, in this order, that does not reach its cap has the final level.
    final = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "passed", "level"))).over(every)["level"]
    return level.withColumn("final", final).select(
        "source", F.col("size").alias("source_size"),
        F.when(F.col("final").isNull(), cap * F.col("size")).otherwise(F.least(F.col("weight") * F.col("final"), cap * F.col("size"))).alias("target"),
    )


def mix_sources(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[float, ...] = WEIGHTS, seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each row of ``docs`` (doc_id, text, source) a mix takes.

    Sources in code point order, null last as a source of its own, have the
    given weights in turn. A row's size is its number of words (ASCII white
    space apart), 0 for null or empty texts, of which nothing is taken. No row
    is taken more than ``cap`` times. Rows with one doc_id are each mixed; an
    empty table gives no rows; other columns are ignored.

    Returns doc_id, size, source_size, target (the source's), taken, first_slot
    (of the mix, that takes words of the row, or null); with ``keep``, these
    columns of the row in place of doc_id. They meet what is taken by a number
    of the row, so null or repeated doc_ids do no harm. The words taken of a
    source are its target, rounded. Plans have one row per source in one task.
    """
    spark = docs.sparkSession
    cells = max(64, 2 * partitions(spark))
    # The kept columns wait in a table of which the plan reads only the rest.
    rows = (staged if keep else checkpointed)(
        docs.select(
            *([F.struct(*keep).alias("kept")] if keep else []),
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id")).alias("order"),
            F.xxhash64("text").alias("tie"),
        ).withColumn("cell", F.pmod("order", F.lit(cells)))
    )
    everything, rows = rows, rows.drop("kept")
    # Where a document begins in its source's stream: running sums over cells of
    # the shuffled order, then within a cell, so no task has a whole source.
    sums = checkpointed(rows.groupBy("source", "cell").agg(F.sum("size").alias("words")))
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "cell", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("cell_start"))
    within = Window.partitionBy("source", "cell").orderBy("order", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))

    sizes = sums.groupBy("source").agg(F.sum("words").alias("size"))
    targets = source_targets(sizes, share, float(cap), weights)
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    block = max(LEAST_BLOCK, int(share * total) // SLOTS)
    own = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(block), F.floor(F.col("source_size") / SOURCE_BLOCKS)))
    # The stream is taken ``rounds`` times and then its first ``rest`` words.
    by_name = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    plan = (
        targets.withColumn("blocks", F.ceil(F.col("source_size") / own))
        .where("blocks > 0")
        .withColumn("goal", F.floor(F.col("target") + 0.5))
        .withColumn("rounds", F.expr("goal div source_size"))
        .withColumn("rest", F.col("goal") - F.col("rounds") * F.col("source_size"))
        .withColumn("whole", F.expr("(blocks * rest - 1) div source_size"))  # blocks before the last one
        .withColumn("whole", F.when(F.col("rest") > 0, F.col("whole")).otherwise(0))
        .withColumn("slots", F.col("rounds") * F.col("blocks") + F.col("whole") + (F.col("rest") > 0).cast("long"))
        .withColumn("part", F.col("rest") - F.expr("(whole * source_size) div blocks"))
        .withColumn("high", F.sum("slots").over(by_name))
        .withColumn("low", F.col("high") - F.col("slots"))
    )
    plan = checkpointed(plan)
    slots = plan.agg(F.coalesce(F.max("high"), F.lit(0)).alias("n")).first().n

    point = F.col("slot") * F.lit(GOLDEN)
    points = spark.range(0, slots, 1, partitions(spark)).withColumnRenamed("id", "slot")
    points = points.withColumn("point", F.least((point - F.floor(point)) * F.lit(float(slots)), F.lit(float(slots) * (1 - 2.0**-52))))
    # Each source owns a stretch of the scale. Cutting the scale into cells makes
    # finding a point's source an equality join on the cell.
    cell = lambda at: F.least(F.floor(at / F.lit(float(max(slots, 1))) * CELLS), F.lit(CELLS - 1))
    of = plan.where("slots > 0").select(
        F.col("source").alias("of_source"), "low", "high", "blocks", F.col("slots").alias("want"), "part",
        F.explode(F.sequence(F.greatest(cell(F.col("low")) - 1, F.lit(0)), F.least(cell(F.col("high")) + 1, F.lit(CELLS - 1)))).alias("cell"),
    )
    dealt = (
        points.withColumn("cell", cell(F.col("point")))
        .join(of, "cell")
        .where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
        .withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    )
    counts = checkpointed(dealt.groupBy("of_source", "chunk").agg(F.count("*").alias("n")))
    first = counts.withColumn(
        "ahead", F.coalesce(F.sum("n").over(Window.partitionBy("of_source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select(F.col("of_source").alias("s"), F.col("chunk").alias("c"), "ahead")
    rank = F.row_number().over(Window.partitionBy("of_source", "chunk").orderBy("slot")) - 1 + F.col("ahead")
    ranked = dealt.join(first, F.col("of_source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).withColumn("rank", rank)
    ranked = ranked.where(F.col("rank") < F.col("want")).select("of_source", "slot", "rank", "blocks", "want", "part")
    got = counts.groupBy(F.col("of_source").alias("s")).agg(F.sum("n").alias("got"))
    late = (
        plan.join(got, F.col("source").eqNullSafe(F.col("s")), "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .where(F.col("got") < F.col("slots"))
        .withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)))
        .select(F.col("source").alias("of_source"), (slots + F.col("low") + F.col("rank")).alias("slot"), "rank", "blocks", F.col("slots").alias("want"), "part")
    )
    partial = (F.col("rank") == F.col("want") - 1) & (F.col("part") > 0)
    uses = (
        ranked.unionAll(late)
        .groupBy("of_source", F.pmod("rank", F.col("blocks")).alias("at_block"))
        .agg(F.count(F.when(~partial, 1)).alias("uses"), F.coalesce(F.max(F.when(partial, F.col("part"))), F.lit(0)).alias("part"), F.min("slot").alias("slot"))
    )

    # What a source's rows need comes with their cell, so no row meets the plan by source alone.
    starts = starts.join(targets.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("blocks", F.ceil(F.col("source_size") / own))
    keyed = placed.join(starts.withColumnsRenamed({"source": "s", "cell": "c"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).drop("s", "c")
    keyed = keyed.withColumn("begin", F.col("cell_start") + F.col("inside"))
    keyed = checkpointed(keyed)
    # Block k of a source has the words from floor(k * size / blocks) on.
    holds = lambda word: F.floor((F.col("blocks") * (word + 1) - 1) / F.col("source_size")).cast("long")
    pieces = keyed.where("size > 0").select(
        "row", "source", "begin", "size", "blocks", "source_size",
        F.explode(F.sequence(F.greatest(holds(F.col("begin")) - 1, F.lit(0)), F.least(holds(F.col("begin") + F.col("size") - 1) + 1, F.col("blocks") - 1))).alias("k"),
    )
    edge = lambda k: F.expr(f"({k} * source_size) div blocks")
    held = lambda end: F.greatest(F.least(F.col("begin") + F.col("size"), end) - F.greatest(F.col("begin"), edge("k")), F.lit(0))
    words = held(edge("(k + 1)")) * F.col("uses") + held(edge("k") + F.col("part"))
    taken = (
        pieces.where(held(edge("(k + 1)")) > 0)
        .join(uses, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("k") == F.col("at_block")))
        .withColumn("words", words)
        .where("words > 0")
        .groupBy("row")
        .agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    )
    found = keyed.join(taken, "row", "left").select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")
    if not keep:
        return found.drop("row")
    return everything.select("row", "kept").join(found.drop("doc_id"), "row").select("kept.*", "size", "source_size", "target", "taken", "first_slot")
