"""Consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

The ring has a fixed number of cells; each shard owns some of them through its virtual nodes, and the rows of a cell go to the
next virtual node clockwise. A shard takes rows in ring order up to its capacity; what overflows continues clockwise to the next
shard with room. Only counts of cells, bounded by the ring, are planned; rows then look up their place. Rows are numbered within
their cell, masses of equal rows in parts, whose counts are then added up.

With ``slack`` a new shard takes rows into itself and little else moves; with exact shares, as the law of equal counts asks for, the
overflow moves as well.

Nulls: a null text has no bytes; rows with a null doc_id are placed by their text. Ties and repeated rows: equal rows take
neighbouring places in either order, so the result is the same set of rows. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.llm.common import MASS, dropped, small, with_masses, written

#: 2 ** BITS cells; the plan has at most as many rows plus a few for each shard.
BITS = 16
VIRTUAL_NODES = 128


def ring(spark, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``cell``, ``shard``: the virtual nodes; where two fall on one cell, the lower shard has it."""
    nodes = spark.range(shards * virtual_nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("copy"))
    at = F.shiftrightunsigned(F.xxhash64(F.lit("virtual node"), "shard", "copy"), 64 - BITS).cast("int")
    return nodes.groupBy(at.alias("cell")).agg(F.min("shard").alias("shard"))


def placed(cells: DataFrame, shards: int, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Where the rows of each cell go: ``cell``, ``low``, ``n`` (rows ``low`` to ``low + n - 1`` of the cell), ``shard``, ``base`` (slot of the first).

    ``cells``: ``cell``, ``n``. With ``slack`` 0 capacities are exact shares, so that counts are at most one apart; else each
    shard holds up to (1 + slack) times the mean.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("n")).first()[0] or 0
    if slack:
        room = {s: -int(-(1 + slack) * total // shards) for s in range(shards)}
    else:
        room = {s: total // shards + (s < total % shards) for s in range(shards)}
    used = dict.fromkeys(room, 0)
    nodes = written(ring(spark, shards, virtual_nodes), "ring")
    pending = written(cells.select("cell", F.lit(0).cast("long").alias("low"), F.col("n").cast("long").alias("n")), "ring-pending")
    done = None
    # Running from the last cell back, the last owner seen is the next one clockwise; frames that grow forwards cost a pass for each row.
    clockwise = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    everywhere = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while total and not pending.isEmpty():
        free = [s for s in room if used[s] < room[s]]
        open_nodes = nodes.where(F.col("shard").isin(free))
        # The next virtual node with room, clockwise from each cell; after the last cell comes the first.
        owner = spark.range(1 << BITS).select(F.col("id").cast("int").alias("cell")).join(open_nodes, "cell", "left")
        owner = owner.select("cell", F.coalesce(F.last("shard", ignorenulls=True).over(clockwise), F.min_by("shard", F.when(F.col("shard").isNotNull(), F.col("cell"))).over(everywhere)).alias("shard"))
        per_shard = lambda d: F.get(F.array(*[F.lit(d[s]).cast("long") for s in range(shards)]), F.col("id").cast("int"))
        state = spark.range(shards).select(F.col("id").cast("int").alias("shard"), per_shard(used).alias("used"), per_shard(room).alias("room"))
        ahead = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        asked = pending.join(F.broadcast(owner), "cell").withColumn("ahead", ahead).join(F.broadcast(state), "shard")
        taken = F.greatest(F.lit(0).cast("long"), F.least("n", F.col("room") - F.col("used") - F.col("ahead")))
        asked = written(asked.select("cell", "low", "n", "shard", taken.alias("taken"), (F.col("used") + F.col("ahead")).alias("base")), "ring-round")
        for s, n in asked.groupBy("shard").agg(F.sum("taken")).collect():
            used[s] += n
        got = asked.where("taken > 0").select("cell", "low", F.col("taken").alias("n"), "shard", "base")
        done = got if done is None else done.unionByName(got)
        dropped(pending)
        pending = written(asked.where("taken < n").select("cell", (F.col("low") + F.col("taken")).alias("low"), (F.col("n") - F.col("taken")).alias("n")), "ring-pending")
    return done if done is not None else pending.limit(0).select("cell", "low", "n", F.lit(0).alias("shard"), F.col("low").alias("base"))


def sharded(docs: DataFrame, shards: int = 24, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` of every row; slots of a shard have no gap."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    crc = F.crc32(F.encode(text, "utf-8"))
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_crc32")))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("number")).withColumn("key", key)
    rows = written(rows.withColumn("cell", F.shiftrightunsigned("key", 64 - BITS).cast("int")), "shard-rows")
    plan = written(placed(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), shards, slack, virtual_nodes), "shard-plan")
    equal = ["key", "doc_id", "text_crc32", "size"]
    # Rows outside of masses come first in their cell, then mass by mass and part by part.
    parts = F.pmod(F.xxhash64("number"), F.ceil(F.col("mass") / MASS))
    rows = with_masses(rows, equal).withColumns({"part": parts, "mass": F.when(F.col("mass").isNotNull(), F.xxhash64(*equal))})
    inside = F.row_number().over(Window.partitionBy("cell", "mass", "part").orderBy(*equal)).cast("long") - 1
    blocks = written(rows.groupBy(F.col("cell").alias("c"), F.col("mass").alias("m"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n")), "shard-blocks")
    in_order = Window.partitionBy("c").orderBy(F.col("m").asc_nulls_first(), "p")
    before = blocks.select("c", "m", "p", (F.sum("n").over(in_order) - F.col("n")).alias("before"))
    before = written(before.where("before > 0"), "shard-before")
    ahead = (F.col("cell") == F.col("c")) & F.col("mass").eqNullSafe(F.col("m")) & F.col("part").eqNullSafe(F.col("p"))
    rank = rows.withColumn("inside", inside).join(small(before), ahead, "left").withColumn("rank", F.col("inside") + F.coalesce("before", F.lit(0)))
    # The plan is bounded by the ring, not by the rows.
    found = rank.select("doc_id", "size", "text_crc32", "cell", "rank").join(F.broadcast(plan), "cell").where("rank >= low and rank < low + n")
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))
