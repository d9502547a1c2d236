"""Benchmark decontamination: item-sized windows, SimHash, multi-index Hamming blocks, exact weighted-shingle check. DataFrame functions only.

Words are runs of letters, marks and digits, lower-cased. A window is as long as a benchmark item, and one at every place of a
document is looked at that can reach the similarity: its five-word shingles that the item has, repeats included, are no fewer than what
the two would have to share, and no window with fewer can reach it. An item of fewer words is one shingle of all its words, and is
looked for among windows of as many. Windows and items get a 64-bit SimHash; blocks of its bits, with every pattern of few flipped bits,
guarantee that a window meets its item if that is within the radius; these are verified by the weighted Jaccard similarity of their
shingles, each weighing as often as it occurs.

Nulls: null texts have no words; a null doc_id or item_id is carried along. Items without a word match nothing; a document of fewer
words than an item's shingles have matches it not, one with fewer shingles than the item is one window. Ties: of the windows of the highest similarity, the earliest counts that
puts a shingle where the item has it, else the earliest. Repeated rows give one result for each doc_id, text and item. Empty tables:
empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.common import small, written
from canopygrid.llm.quality_rules import let

SHINGLE = 5
RADIUS, BLOCKS = 20, 8
LEAST = 0.8
#: Shingles of the benchmark that are looked up as a set of literals, and as a broadcast table, 16 bytes each; only a larger benchmark makes the documents' shingles meet it.
LITERALS, BROADCAST_SHINGLES = 50_000, 4_000_000
NO_WORD = r"[^\p{L}\p{M}\p{N}]+"


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """Hashes of the ``k``-word shingles of a text, in order."""
    of_words = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
    none = F.array().cast("array<bigint>")
    return let(F.transform(text_words(text), lambda w: F.xxhash64(w)), lambda w: F.when(F.size(w) < k, none).otherwise(of_words(w)))


def simhash(h: Column) -> Column:
    """The 64-bit SimHash of an array of hashes: bits set in over half of them."""
    bit = lambda k: F.aggregate(h, F.lit(0), lambda a, x: a + (F.shiftrightunsigned(x, k).bitwiseAND(F.lit(1))).cast("int"))
    return reduce(lambda a, k: a.bitwiseOR(F.when(2 * bit(k) > F.size(h), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))), range(64), F.lit(0).cast("long"))


def block_patterns(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The flips of a block that reach every fingerprint within ``radius``: some block differs in at most radius / blocks bits."""
    bits = 64 // blocks
    return [sum(1 << b for b in some) for n in range(radius // blocks + 1) for some in combinations(range(bits), n)]


def _blocks(fp: Column) -> Column:
    bits = 64 // BLOCKS
    return F.array(*[F.shiftrightunsigned(fp, bits * b).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for b in range(BLOCKS)])


def shared_weight(a: Column, b: Column) -> Column:
    """Sum over the distinct shingles of the smaller of the counts in ``a`` and ``b``."""
    count = lambda h, x: F.size(F.filter(h, lambda y: y == x))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    # Shingles that are all different in b count once each, without looking for repeats.
    return F.when(F.size(F.array_distinct(b)) == F.size(b), F.size(F.array_intersect(a, b))).otherwise(counted)


def able(places: Column, n: Column, m: Column, least: float) -> Column:
    """Starts of all windows of ``m`` shingles, or of all ``n`` if they are fewer, with enough of ``places`` to reach ``least``, in order.

    ``places`` are sorted: where the item's shingles occur. A window belongs to the first place in it, so no start comes twice.
    """
    w = F.least(n, m)
    # s / (w + m - s) >= least; what rounding could take away is left in.
    k = F.greatest(F.lit(1), F.ceil(F.lit(least / (1 + least)) * (w + m) - 1e-6)).cast("int")

    def run(first: Column, i: Column) -> Column:
        after = F.when(i > 0, F.get(places, i - 1) + 1).otherwise(0)
        low, high = F.greatest(F.get(places, i + k - 1) - w + 1, after, F.lit(0)), F.least(first, n - w)
        return F.when((i + k <= F.size(places)) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(places) < k, F.array().cast("array<int>")).otherwise(F.flatten(F.transform(places, run)))


def _located(docs: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``h`` (shingles) and ``at``, places of shingles that the benchmark has, of documents with any."""
    barrier = lambda df, value, name: df.select(*df.columns, F.explode(F.array(value)).alias(name))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.explode(F.array(shingles(F.col("text").cast("string"), k))).alias("h"))
    if (known := anchors.select("shingle").distinct()).limit(LITERALS + 1).count() <= LITERALS:
        some = ",".join(f"{r.shingle}L" if r.shingle != -(1 << 63) else "(-9223372036854775807L - 1L)" for r in known.collect()) or "NULL"
        at = F.expr(f"filter(transform(h, (x, i) -> if(x IN ({some}), i, null)), y -> y IS NOT NULL)")
        return barrier(rows, at, "at").where(F.size("at") > 0)
    places = rows.select("doc_id", "text_hash", F.posexplode("h").alias("place", "shingle")).join(small(known, BROADCAST_SHINGLES), "shingle", "left_semi")
    places = written(places.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.sort_array(F.collect_set("place")).alias("at")), "leak-places")
    return rows.join(small(places, 1_000_000), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).drop("d", "t")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``item_id``, ``start`` (first word, from 0), ``shared``, ``similarity``: the best window for each document and item."""
    sizes = F.least(F.lit(SHINGLE), F.size(text_words(F.col("text").cast("string"))))
    sized = benchmark.select("item_id", "text", sizes.alias("k"))
    # Items of one word, of two and so on, if there are any, and those of five or more.
    some = [r.k for r in sized.where("k > 0").select("k").distinct().collect()] or [SHINGLE]
    found = [_leaks(docs, sized.where(F.col("k") == k), k, least, radius) for k in sorted(some)]
    return reduce(DataFrame.unionByName, found)


def _leaks(docs: DataFrame, benchmark: DataFrame, k: int, least: float, radius: int) -> DataFrame:
    """``leaks`` by shingles of ``k`` words."""
    items = benchmark.select("item_id", F.explode(F.array(shingles(F.col("text").cast("string"), k))).alias("item")).where(F.size("item") > 0)
    items = written(items.withColumns({"b": F.monotonically_increasing_id(), "m": F.size("item"), "item_fp": simhash(F.col("item"))}), "leak-items")
    anchors = written(items.select("b", "m", F.posexplode("item").alias("q", "shingle")), "leak-anchors")
    # Only documents with a shingle of the benchmark are kept, with their shingles once, however many places and windows they have.
    found = written(_located(docs, anchors, k).withColumn("row", F.monotonically_increasing_id()), "leak-documents")
    place = lambda p: F.struct(p.alias("p"), F.get("h", p).alias("shingle"))
    hits = found.select("row", F.size("h").alias("n"), F.explode(F.transform("at", place)).alias("x")).select("row", "n", "x.*")
    put = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("m")))
    met = hits.join(small(anchors, BROADCAST_SHINGLES), "shingle").groupBy("row", "b", "n", "m").agg(F.sort_array(F.collect_set("p")).alias("places"), F.collect_set(put).alias("put"))
    asked = met.select("row", "b", "m", "put", F.least("n", "m").alias("w"), F.explode(F.array(able(F.col("places"), F.col("n"), F.col("m"), least))).alias("starts")).where(F.size("starts") > 0)
    # What the windows of a document and an item cover is kept once, however many windows lie in it.
    first, over = F.get("starts", F.lit(0)), F.get("starts", F.size("starts") - 1) + F.col("w")
    asked = found.join(asked, "row").select("row", "doc_id", "text_hash", "b", "m", "w", "starts", "put", first.alias("first"), F.slice("h", first + 1, over - first).alias("covered"))
    asked = written(asked, "leak-windows")
    window = lambda start: F.slice("covered", start - F.col("first") + 1, F.col("w"))
    prints = F.transform("starts", lambda x: F.struct(x.alias("start"), F.array_contains("put", x).alias("put"), let(window(x), simhash).alias("fp")))
    windows = written(asked.select("row", "b", F.explode(prints).alias("x")).select("row", "b", "x.*"), "leak-prints")

    patterns = F.array(*map(F.lit, block_patterns(radius)))
    probes = items.select("b", "item_fp", F.posexplode(_blocks(F.col("item_fp"))).alias("block", "bits")).withColumn("key", F.explode(F.transform(patterns, lambda p: p.bitwiseXOR(F.col("bits"))))).drop("bits")
    probes = written(probes, "leak-probes")
    pairs = windows.select("row", "b", "start", "put", "fp", F.posexplode(_blocks(F.col("fp"))).alias("block", "key")).join(small(probes), ["b", "block", "key"])
    # A pair meets in several blocks; it counts in the first of them.
    shared_blocks = F.transform(F.arrays_zip(_blocks(F.col("fp")).alias("a"), _blocks(F.col("item_fp")).alias("b")), lambda x: F.bit_count(x["a"].bitwiseXOR(x["b"])) <= radius // BLOCKS)
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).where(F.array_position(shared_blocks, True) == F.col("block") + 1)
    near = written(pairs.groupBy("row", "b").agg(F.collect_list(F.struct("start", "put")).alias("near")), "leak-near")

    def exact(x: Column) -> Column:
        scored = lambda n: F.struct((n / (F.col("w") + F.col("m") - n)).alias("similarity"), x["put"].alias("put"), (-x["start"]).alias("start"), n.alias("shared"))
        return let(shared_weight(window(x["start"]), F.col("item")), scored)

    of_items = items.select("item_id", "b", "item")
    best = asked.join(near, ["row", "b"]).join(small(of_items), "b").select("doc_id", "text_hash", "item_id", F.explode(F.array(F.array_max(F.transform("near", exact)))).alias("best"))
    best = best.where(F.col("best.similarity") >= least).groupBy("doc_id", "text_hash", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("best.start")).cast("long").alias("start"), F.col("best.shared").cast("long").alias("shared"), "best.similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = written(leaks(docs, benchmark, least).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct(), "leaking")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__text"))
    return docs.join(small(found), same, "left_anti")


_WORDS = r"[w FOR w IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+') IF w <> '']"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT row_number() OVER () AS b, item_id, {_WORDS} AS ws FROM benchmark),
z AS (SELECT b, item_id, ws, least(5, len(ws)) AS z FROM i WHERE len(ws) > 0),
ds AS (SELECT r, z, p, array_to_string(ws[p + 1:p + z], ' ') AS k FROM (SELECT r, ws, z, unnest(range(0, len(ws) - z + 1)) AS p FROM d, (SELECT DISTINCT z FROM z))),
bs AS (SELECT b, z, len(ws) - z + 1 AS m, q, array_to_string(ws[q + 1:q + z], ' ') AS k FROM (SELECT b, ws, z, unnest(range(0, len(ws) - z + 1)) AS q FROM z)),
win AS (SELECT DISTINCT ds.r, z, b, greatest(0, least(p - q, len(d.ws) - z + 1 - m)) AS s, m FROM ds JOIN bs USING (z, k) JOIN d ON d.r = ds.r),
wk AS (SELECT win.r, win.z, s, m, k, count(*) AS n FROM (SELECT DISTINCT r, z, s, m FROM win) win JOIN ds ON ds.r = win.r AND ds.z = win.z AND ds.p >= s AND ds.p < s + m GROUP BY ALL),
bk AS (SELECT b, z, m, k, count(*) AS n FROM bs GROUP BY ALL),
wt AS (SELECT r, z, s, m, CAST(sum(n) AS BIGINT) AS total FROM wk GROUP BY ALL),
c AS (SELECT r, z, s, m, b, CAST(sum(least(wk.n, bk.n)) AS BIGINT) AS shared FROM win JOIN wk USING (r, z, s, m) JOIN bk USING (b, z, m, k) GROUP BY ALL),
v AS (SELECT r, b, s, shared, shared / (total + m - shared) AS similarity FROM c JOIN wt USING (r, z, s, m)),
best AS (SELECT *, row_number() OVER (PARTITION BY r, b ORDER BY similarity DESC, s) AS n FROM v WHERE similarity >= {LEAST})
SELECT d.doc_id, i.item_id, CAST(s AS BIGINT) AS start, shared, similarity FROM best JOIN d USING (r) JOIN i USING (b) WHERE n = 1
"""
