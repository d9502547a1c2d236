"""Near-duplicate lines by a segment-partition edit join. DataFrame functions only.

Distinct lines are linked if at most ``edits`` edits, and at most one for each ``PER_EDIT`` characters of the longer one, lie between
them: a line is cut into one segment more than the edits that its length allows, one of which an equal or longer partner must hold
unchanged; lines probe the segments of all lengths that partners can have, at the few places where that segment can lie, and
candidates are verified by a banded bit-parallel edit distance. Classes of lines are the components of the links; the first line of a
class, by doc_id and line number, stays and the others go. Equal lines are one text from the start, however many there are.

Where many lines share a segment, what is left of them without it is cut into segments again, and must share one of these as well.

Lines are cut at line feeds and trimmed; lines without a word are not looked at. Nulls: a null text has no lines; rows with a null doc_id come last. Rows that repeat a doc_id are one document.
Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.common import WORD, small, written
from canopygrid.llm.components import components
from canopygrid.llm.quality_rules import let

EDITS = 2
PER_EDIT = 5
#: Line ids that may be broadcast, 8 bytes each.
BROADCAST_IDS = 500_000
#: Lines of a key that are weighed against each other in one array, on average.
PART = 64
#: Lines of a key from which on a second segment is asked for, and how often that is done.
SPLIT, DEEPER = 1024, 3
TOP = 31
MASK = (1 << (TOP + 1)) - 1


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no``, ``line``; one row of nulls for a document without lines."""
    cut = F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line_no"), F.btrim(x, F.lit(" \t\r\x0b\x0c")).alias("line")))
    return docs.select("doc_id", F.explode_outer(F.filter(cut, lambda x: x["line"].rlike(WORD))).alias("x")).select("doc_id", "x.line_no", "x.line")


def edits_of(chars: Column, edits: int = EDITS) -> Column:
    """The most edits between a line of ``chars`` characters and one that is as long or longer: k edits need a partner of k * PER_EDIT characters, and it is at most k longer."""
    return F.least(F.lit(edits), F.floor(chars / (PER_EDIT - 1)).cast("int"))


def segment(chars: Column, i: Column, parts: Column) -> tuple[Column, Column]:
    """Start, from 0, and length of segment ``i`` of ``parts`` of a line of ``chars`` characters; the longer segments come last."""
    short = F.floor(chars / parts).cast("int")
    longer_from = parts - chars % parts
    return i * short + F.greatest(F.lit(0), i - longer_from), short + F.when(i >= longer_from, 1).otherwise(0)


def probes(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(difference in length, segment, shift): where a line has to look for a segment of an equal or shorter one.

    Left of a segment lie at most ``segment`` edits, right of it at most ``edits - segment``, or another segment would fit.
    """
    return [(d, i, o) for d in range(edits + 1) for i in range(edits + 1) for o in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1)]


def wide_text(line: Column) -> Column:
    """Four bytes for each character, so that a substring is a slice of bytes."""
    return F.encode(line, "UTF-32")


def without(wide: Column, cuts: Column) -> Column:
    """What is left of a wide text when segments (``start``, ``size``) are taken out one after another."""
    return F.aggregate(cuts, wide, lambda w, c: F.concat(F.substring(w, F.lit(1), c["start"] * 4), F.substring(w, (c["start"] + c["size"]) * 4 + 1, F.octet_length(w))))


def keyed(rows: DataFrame, edits: int = EDITS) -> DataFrame:
    """``id``, ``key``, ``own``, ``d``, ``e``, ``cuts``: a row for each place to look at in each line; ``own`` marks the line's own segments.

    ``rows``: ``id``, ``wide``, and what led here: ``key``, ``own``, ``cuts``, and ``d`` and ``e`` (how much shorter the partner is, and
    how many edits its length allows), null at first. Places are rows before keys are made: one short expression, which compiles well,
    instead of one for each place.
    """
    some = lambda es: F.array(*[F.struct(F.lit(e).alias("e"), F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(o).alias("o")) for e in es for d, i, o in probes(e)])
    chars = F.floor(F.octet_length("wide") / 4).cast("int")
    # All partners of a line that is long enough allow as many edits; a row that has its edits keeps them.
    places = F.when(F.coalesce(F.col("e") == edits, chars - edits >= edits * (PER_EDIT - 1)), some([edits])).otherwise(some(range(1, edits + 1)))
    at = rows.select("id", "wide", "key", "own", "cuts", "d", "e", chars.alias("chars"), F.explode(places).alias("p"))
    fits = F.when(F.col("e").isNull(), F.col("p.e") == edits_of(F.col("chars") - F.col("p.d"), edits)).otherwise((F.col("p.e") == F.col("e")) & (F.col("p.d") == F.col("d")))
    at = at.where(fits).select("id", "wide", "key", "own", "cuts", "p.d", "p.e", "p.i", "p.o", (F.col("chars") - F.col("p.d")).alias("chars"))
    start, size = segment(F.col("chars"), F.col("i"), F.col("e") + 1)
    at = at.withColumns({"start": start + F.col("o"), "size": size}).where("start >= 0")
    key = F.xxhash64("key", "chars", "i", F.substring(F.col("wide"), F.col("start") * 4 + 1, F.col("size") * 4))
    own = F.col("own") & (F.col("d") == 0) & (F.col("o") == 0)
    return at.select("id", key.alias("key"), own.alias("own"), "d", "e", F.concat("cuts", F.array(F.struct("start", "size"))).alias("cuts"))


def shared_keys(rows: DataFrame) -> DataFrame:
    """``key``, ``n`` of the keys that more than one line has, one of them as its own. Counts combine before they meet, so a key that many lines have burdens no task."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned")).where("n > 1 and owned").select("key", "n")


def code_points(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))


def pair_parity(points: Column) -> Column:
    """64 bits: whether the pairs of neighbouring characters in each of 64 classes are odd in number. An edit changes at most four."""
    at = lambda i: (F.get(points, i) * 31 + F.get(points, i + 1) * 17).bitwiseAND(F.lit(63))
    flips = F.transform(F.sequence(F.lit(0), F.size(points) - 2), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), at(i)))
    return F.when(F.size(points) < 2, F.lit(0).cast("long")).otherwise(F.aggregate(flips, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)))


def banded_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two arrays of characters, at least as long ``a`` as ``b`` and by at most ``edits``; over ``edits`` it may be more than the distance.

    The band of 2 * edits + 1 cells around the diagonal is one machine word; a column of the matrix takes a few operations on it.
    """
    mask, zero = F.lit(MASK).cast("long"), F.lit(0).cast("long")
    m, n = F.size(a), F.size(b)
    start = F.struct(F.lit(MASK ^ ((1 << (TOP - edits)) - 1)).cast("long").alias("vp"), zero.alias("vn"), F.lit(edits).alias("dist"))

    def column(s: Column, i: Column) -> Column:
        equal = zero
        for k in range(2 * edits + 1):
            hit = F.coalesce(F.get(a, i + (edits - k)) == F.get(b, i), F.lit(False))
            equal = equal.bitwiseOR(F.when(hit, F.lit(1 << (TOP - k)).cast("long")).otherwise(zero))

        def after_equal(x: Column) -> Column:
            d0 = (x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(mask)

            def after_d0(d: Column) -> Column:
                hp = s["vn"].bitwiseOR(F.bitwise_not(d.bitwiseOR(s["vp"]))).bitwiseAND(mask)
                hn = d.bitwiseAND(s["vp"])
                down = F.shiftright(d, 1)

                def after_hp(h: Column) -> Column:
                    # Along the diagonal the score grows unless D0 has the top bit; after the last row it moves along the row.
                    edge = F.call_function("shiftright", F.lit(1 << (TOP - 1)).cast("long"), i - (m - edits))
                    bit = lambda v: F.when(v.bitwiseAND(edge) != 0, 1).otherwise(0)
                    diagonal = F.when(d.bitwiseAND(F.lit(1 << TOP).cast("long")) != 0, 0).otherwise(1)
                    dist = s["dist"] + F.when(i < m - edits, diagonal).otherwise(bit(h) - bit(hn))
                    vp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(h))).bitwiseAND(mask)
                    return F.struct(vp.alias("vp"), down.bitwiseAND(h).alias("vn"), dist.alias("dist"))

                return let(hp, after_hp)

            return let(d0, after_d0)

        return let(equal, after_equal)

    return F.aggregate(F.sequence(F.lit(0), n - 1), start, column, lambda s: s["dist"])


def line_links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """``a``, ``b``: ids of all pairs of distinct lines (``id``, ``line``, ``chars``) that are linked.

    First the keys that more than one line has, then the few lines that have such keys: only their texts and parities are needed, and
    pairs within a key are weighed in arrays of at most some hundred lines, so that only pairs that pass become rows.
    """
    long = lines.where(F.col("chars") >= PER_EDIT - 1)
    no_cut = F.array().cast("array<struct<start: int, size: int>>")
    none = F.lit(None).cast("int")
    # The array keeps the encoding of a line from being done again for each place.
    first = long.select("id", F.explode(F.array(wide_text(F.col("line")))).alias("wide"), F.lit(0).cast("long").alias("key"), F.lit(True).alias("own"), no_cut.alias("cuts"), none.alias("d"), none.alias("e"))
    keys = written(shared_keys(keyed(first, edits).select("key", "own")), "line-keys")
    shared = written(keyed(first, edits).join(small(keys, BROADCAST_IDS), "key"), "line-places")
    for _ in range(DEEPER):
        hot = shared.where(F.col("n") > SPLIT)
        if hot.isEmpty():
            break
        ids = written(hot.select("id").distinct(), "line-hot")
        again = hot.drop("n").join(long.select("id", "line").join(small(ids, BROADCAST_IDS), "id", "left_semi"), "id")
        again = written(keyed(again.withColumn("wide", without(wide_text(F.col("line")), F.col("cuts"))), edits), "line-deeper")
        keys = written(shared_keys(again), "line-keys")
        shared = written(shared.where(F.col("n") <= SPLIT).unionByName(again.join(small(keys, BROADCAST_IDS), "key")), "line-places")
    shared = shared.drop("cuts")
    ids = written(shared.select("id").distinct(), "line-ids")
    texts = long.select("id", "line").join(small(ids, BROADCAST_IDS), "id", "left_semi").select("id", F.explode(F.array(code_points(F.col("line")))).alias("points"))
    texts = written(texts.withColumn("parity", pair_parity(F.col("points"))), "line-points")
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = shared.join(texts.select("id", "parity"), "id").withColumn("mine", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = dealt.groupBy("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(F.collect_list(F.struct("id", "own", "parity")).alias("c"))
    # One of the two at least holds the segment as its own; both do, if they are equally long and neither shifts.
    near = lambda x, y: (x["own"] | y["own"]) & (x["id"] < y["id"]) & (F.bit_count(x["parity"].bitwiseXOR(y["parity"])) <= 4 * edits)
    met = F.flatten(F.transform("c", lambda x: F.transform(F.filter("c", lambda y: near(x, y)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
    pairs = written(cells.select(F.explode(met).alias("p")).select("p.*").distinct(), "line-pairs")
    side = lambda name, points: texts.select(F.col("id").alias(name), F.col("points").alias(points))
    both = pairs.join(side("a", "s"), "a").join(side("b", "t"), "b").where(F.abs(F.size("s") - F.size("t")) <= edits)
    swap = F.size("s") < F.size("t")
    both = both.select("a", "b", F.explode(F.array(F.struct(F.when(swap, F.col("t")).otherwise(F.col("s")).alias("s"), F.when(swap, F.col("s")).otherwise(F.col("t")).alias("t")))).alias("x"))
    allowed = F.least(F.lit(edits), F.floor(F.size("x.s") / PER_EDIT).cast("int"))
    return both.where(let(F.col("x.s"), lambda s: let(F.col("x.t"), lambda t: banded_distance(s, t, edits))) <= allowed).select("a", "b")


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """A row for each line: ``doc_id``, ``line_no``, ``class_doc`` and ``class_line`` (where its class begins), ``n_links``, ``removed``.

    ``n_links`` counts other texts that a line is linked with. Lines go where another line begins their class.
    """
    found = lines_of(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("line_no"))).alias("first")
    texts = found.where("line is not null").groupBy("line").agg(F.count(F.lit(1)).alias("n"), first)
    texts = texts.select(F.monotonically_increasing_id().alias("id"), "line", F.char_length("line").alias("chars"), F.unhex(F.md5("line")).alias("key"), "n", "first")
    texts = written(texts, "line-texts-distinct")
    links = written(line_links(texts, edits), "line-links")
    roots = components(links, "line-classes")
    members = written(roots.select(F.col("node").alias("id"), "root").unionByName(roots.select(F.col("root").alias("id"), "root")).distinct(), "line-members")
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    members = written(members.join(degree, "id"), "line-degrees")
    named = texts.select("id", "key", "n", "first").join(small(members, BROADCAST_IDS), "id", "left").where("n > 1 or root is not null")
    named = written(named.withColumn("root", F.coalesce("root", "id")), "line-named")
    begins = written(named.groupBy("root").agg(F.min("first").alias("begin")), "line-begins")
    decided = written(named.join(small(begins, BROADCAST_IDS), "root").select("key", "begin", F.coalesce("n_links", F.lit(0)).alias("n_links")), "line-decided")
    placed = found.withColumn("key", F.unhex(F.md5("line"))).select("doc_id", "line_no", "key").join(small(decided, BROADCAST_IDS), "key", "left")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("line_no"))
    return placed.select(
        "doc_id", "line_no", F.when(F.col("begin").isNull(), F.col("doc_id")).otherwise(F.col("begin.doc_id")).alias("class_doc"), F.coalesce("begin.line_no", "line_no").alias("class_line"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("begin").isNotNull() & ~F.col("begin").eqNullSafe(own)).alias("removed"),
    )


def per_document(lines: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed``, ``n_links``, and ``class_id``: the smallest doc_id where one of its lines' classes begins, its own without lines."""
    one = F.when(F.col("line_no").isNotNull(), 1).otherwise(0)
    return lines.groupBy("doc_id").agg(F.sum(one).cast("long").alias("n_lines"), F.count_if("removed").alias("n_removed"), F.sum("n_links").cast("long").alias("n_links"), F.min("class_doc").alias("class_id"))


def deduplicated(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` with the removed lines taken out of each text."""
    gone = line_classes(docs, edits).where("removed").groupBy(F.col("doc_id").alias("__from")).agg(F.collect_set("line_no").alias("__gone"))
    keep = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce(F.col("__gone"), F.array().cast("array<int>")), i))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__from")), "left").withColumn("text", F.array_join(keep, "\n")).drop("__gone", "__from")


#: DuckDB counts bytes, so characters are numbered within a pair first, where there are any of more than one byte.
_NUMBERED = "array_to_string([chr(CAST(list_position(list_distinct(string_split(x.line || y.line, '')), c) AS INTEGER)) FOR c IN string_split({}.line, '')], '')"
_IN_CHARACTERS = f"CASE WHEN strlen(x.line) = x.chars AND strlen(y.line) = y.chars THEN levenshtein(x.line, y.line) WHEN levenshtein(x.line, y.line) > {4 * EDITS} THEN {4 * EDITS} ELSE levenshtein({_NUMBERED.format('x')}, {_NUMBERED.format('y')}) END"
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
o AS (SELECT doc_id, no, trim(ls[no + 1], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS no FROM d)),
occ AS (SELECT * FROM o WHERE regexp_matches(line, '{WORD}')),
t AS MATERIALIZED (SELECT line, length(line) AS chars, length(line) // 3 AS k, count(*) AS n, min(doc_id) AS fd, arg_min(no, (doc_id, no)) AS fl, row_number() OVER (ORDER BY line) AS id FROM occ GROUP BY line),
link AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON y.chars BETWEEN x.chars AND x.chars + {EDITS} AND x.id <> y.id AND x.chars >= {PER_EDIT - 1}
  WHERE (substr(x.line, 1, x.k) = substr(y.line, 1, x.k) OR right(x.line, x.k) = right(y.line, x.k) OR contains(y.line, substr(x.line, x.k + 1, x.k))) AND {_IN_CHARACTERS} <= least({EDITS}, y.chars // {PER_EDIT})),
e AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS id, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id),
root AS (SELECT id, min(r) AS r FROM reach GROUP BY id),
m AS (SELECT t.id, line, fd, fl, coalesce(root.r, t.id) AS r, (SELECT count(*) FROM e WHERE e.a = t.id) AS n_links FROM t LEFT JOIN root USING (id)),
c AS (SELECT r, min((fd, fl)) AS f FROM m GROUP BY r),
z AS (SELECT m.line, c.f[1] AS cd, c.f[2] AS cl, n_links FROM m JOIN c USING (r)),
p AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id <> cd OR no <> cl) AS n_removed, sum(n_links) AS n_links, min(cd) AS cd FROM occ JOIN z USING (line) GROUP BY doc_id)
SELECT DISTINCT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(cd, d.doc_id) AS class_id
FROM d LEFT JOIN p USING (doc_id)
"""
