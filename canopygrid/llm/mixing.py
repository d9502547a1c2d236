"""Mix sources to target weights by pivotal dependent rounding over a distributed tree. DataFrame functions only.

Each source's target divided by its size gives the copies of each of its documents; the whole part is taken, and the fractions are
rounded in pairs: mass moves at random from one document to its neighbour in size until one of the two is 0 or 1. Small groups do
so on their own; what is left of each, one document with a fraction, goes up a tree, by size first and then over the source.

Groups are dealt by doc_id and text; rows that repeat both in masses are dealt by their number, so no group grows with a repeated or
missing doc_id.

Nulls: a null text has size 0; null is a source of its own, last in order. A source without words gets the target 0. Ties and
repeated rows: equal rows are interchangeable. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.llm.common import n_words, small, with_masses, written

#: Documents of a group, on average; groups of a node of the tree.
FAN = 64
WEIGHTS = (3, 1, 2)


def size_class(size: Column) -> Column:
    """Four classes for each doubling of the size."""
    return F.floor(4 * F.log2(size + 1)).cast("int")


def ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``rank``, from 0, of ``source`` by code point, null last: numbered in ranges, whose counts are then added up."""
    order = F.col("source").asc_nulls_last()
    ranges = written(sizes.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    # One row for each range, not for each source.
    before = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranges.withColumn("inside", inside).join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("inside")).drop("range", "before", "inside")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (``source``, ``source_size``) with ``target``: weights repeat over the sources by code point, null last.

    All sources together get ``share`` of all sizes, each by weight but at most ``most`` times its own size; what one can't take
    goes to the others by weight.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written(ranked(sizes).withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).drop("rank"), "mix-weights")
    goal = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = F.col("cap") <= level * F.col("weight")
        now = table.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~capped, F.col("weight")))).first()
        if now[0] == full or not now[2]:
            return table.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))
        full, level = now[0], max(level, (goal - now[1]) / now[2])


def chance(*cols) -> Column:
    """A number from 0 up to 1 that only the values decide."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def settled(items: Column) -> Column:
    """Fold an array of ``item`` (``p``, ``u``, ...) in order into ``out``, items with ``copies`` 0 or 1, and ``cur``, the one left with a fraction."""
    blank = F.filter(items, lambda x: F.lit(False))
    start = F.struct(F.transform(blank, lambda x: F.struct(x.alias("item"), F.lit(0).alias("copies"))).alias("out"), F.get(items, F.lit(0)).alias("cur"))

    def step(a: Column, x: Column) -> Column:
        cur, total = a["cur"], a["cur"]["p"] + x["p"]
        low = total < 1
        # Below 1 the loser gets 0 and the winner all; else the winner gets 1 and the loser the rest.
        first = F.when(low, x["u"] * total >= x["p"]).otherwise(x["u"] * (2 - total) >= 1 - x["p"])
        stays = F.when(first, cur).otherwise(x).withField("p", F.when(low, total).otherwise(total - 1))
        goes = F.when(first, x).otherwise(cur)
        return F.struct(F.concat(a["out"], F.array(F.struct(goes.alias("item"), F.when(low, 0).otherwise(1).alias("copies")))).alias("out"), stays.alias("cur"))

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), start, step)


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 11, row: str | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` of every document; ``row``: a column that identifies rows and is returned under its name."""
    row_id = F.col(f"`{row}`") if row else F.lit(None).cast("long")
    text = F.col("text").cast("string")
    base = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("number"), row_id.alias("row_id")), "mix-sizes")
    base = with_masses(base, ["doc_id", "text_hash"]).withColumn("tie", F.when(F.col("mass").isNotNull(), F.col("number")))
    by_class = base.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    by_class = written(by_class.withColumn("groups", F.ceil(F.col("n") / FAN)), "mix-classes")
    sources = written(targets(by_class.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights), "mix-targets")
    classes = by_class.select(F.col("source").alias("s"), F.col("class").alias("c"), "groups").join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    classes = written(classes.withColumn("rate", rate), "mix-plan")
    rows = base.join(small(classes), base.source.eqNullSafe(classes.s) & (size_class(base.size) == classes.c)).drop("s", "c")
    rows = rows.withColumn("whole", F.floor("rate"))
    item = F.struct(F.col("size"), F.xxhash64("doc_id", "text_hash", "tie", F.lit(seed)).alias("h"), F.col("doc_id"), (F.col("rate") - F.col("whole")).alias("p"), F.lit(0.0).alias("u"), F.col("whole"), F.col("row_id"))
    group = F.pmod(F.xxhash64("doc_id", "text_hash", "tie", F.lit(seed + 1)), F.col("groups"))
    level = rows.select("source", "source_size", "target", size_class(F.col("size")).alias("class"), group.alias("node"), item.alias("item"))
    depth, most_groups = 0, by_class.agg(F.max("groups")).first()[0] or 0
    keys, out = ["source", "source_size", "target"], []
    while True:
        by = [*keys, "class", "node"] if most_groups else keys
        drawn = F.transform(F.sort_array(F.collect_list("item")), lambda x: x.withField("u", chance(x["h"], x["size"], F.lit(seed + 2 + depth))))
        folded = written(level.groupBy(*by).agg(drawn.alias("items")).select(*by, settled(F.col("items")).alias("r")), f"mix-level-{depth}")
        out.append(folded.select(*keys, F.explode("r.out").alias("o")).select(*keys, "o.item", "o.copies"))
        if not most_groups:
            break
        most_groups = 0 if most_groups == 1 else -(-most_groups // FAN)
        depth += 1
        level = folded.select(*by, F.col("r.cur").alias("item"))
        if most_groups:
            level = level.withColumn("node", F.floor(F.col("node") / FAN))
    # The last fraction of a source is drawn by itself.
    last = F.when(chance("r.cur.h", "r.cur.size", F.lit(seed)) < F.col("r.cur.p"), 1).otherwise(0)
    out.append(folded.select(*keys, F.col("r.cur").alias("item"), last.alias("copies")))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    named = [F.col("item.row_id").alias(row)] if row else []
    return every.select("item.doc_id", "source", "item.size", "source_size", "target", (F.col("item.whole") + F.col("copies")).alias("copies"), *named)


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    taken = written(mixed(numbered, row=row, **how).where("copies > 0").select(row, F.col("copies").cast("int").alias(row + "_copies")), "mix-taken")
    repeated = numbered.join(small(taken, 1_000_000), row).withColumn(row, F.explode(F.sequence(F.lit(1), F.col(row + "_copies"))))
    return repeated.select(*docs.columns)
