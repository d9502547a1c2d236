"""SimHash near-duplicates: fingerprints, blocks, bit-sliced comparison, components.

Documents with one fingerprint are one class. Classes meet in buckets that no link can avoid, are compared there
bit-sliced, and each bucket gives a spanning forest of its links, never all pairs. Components follow from the forests.

Nulls: a null text counts as empty; a null doc_id takes its class from its fingerprint and names no class.
Ties and repeated rows: equal ids and equal texts share one class. Empty table: empty result.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.bitslice import Planes, merged
from canopygrid.llm.common import small, written
from canopygrid.llm.components import components

SEED = 42
#: Rows of a bucket that are compared in one task; larger buckets are cut into parts, and parts meet in pairs.
PART = 2048
#: Bytes of text that are tokenised at once.
SLICE = 1 << 20
#: Odd multipliers that give further 64-bit words of a wide fingerprint from one hash, and the keys for shared shingles.
MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(32)], dtype=np.uint64)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th pseudo-random permutation of 64-bit hashes; 0 leaves them as they are."""
    if not i:
        return h
    x = (h ^ MIX[i]) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: bytes, k: int):
    """Yield arrays of the XXH64 of each k-word shingle of the text, A-Z lower-cased; a slice of the text at a time."""
    carry: list[bytes] = []
    seen, at = 0, 0
    one = xxhash.xxh64_intdigest
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        words = carry + text[at:end].lower().split()
        at = end
        if len(words) >= k:
            line = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            start = np.cumsum(size + 1) - size - 1
            stop = start[k - 1 :] + size[k - 1 :]
            seen += 1
            yield np.fromiter((one(line[a:b], SEED) for a, b in zip(start.tolist(), stop.tolist())), np.uint64, len(stop))
        carry = words[-(k - 1) :] if k > 1 else []
    if not seen and carry:
        yield np.array([one(b" ".join(carry), SEED)], np.uint64)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct ``shingle_hashes`` of the whole text, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, k)]))


def fingerprint(hashes, width: int, keys: int) -> tuple[bytes, list[int] | None]:
    """``width`` 64-bit words, most significant first, and the smallest of ``keys`` permutations of arrays of shingle hashes."""
    ones, n = np.zeros((width, 64), np.int64), 0
    least = np.full(keys, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for h in hashes:
        n += len(h)
        for w in range(width):
            bits = np.unpackbits(mixed(h, w).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[w] += bits.sum(0, dtype=np.int64)
        for i in range(keys):
            least[i] = min(least[i], mixed(h, 8 + i).min())
    out = np.packbits((2 * ones > n).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out.astype(">u8").tobytes(), [int(x) for x in least.astype(np.int64)] if keys else None


def fingerprints(docs: DataFrame, words: int = 3, width: int = 1, keys: int = 0) -> DataFrame:
    """``doc_id``, ``fp`` (binary, 8 bytes per word) and ``keys`` (null unless asked for) of every document."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(shingle_hashes(t.as_py() or b"", words), width, keys) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in found], pa.binary()), pa.array([k for _, k in found], pa.list_(pa.int64()))], names=["doc_id", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp binary, keys array<long>")


def set_fingerprints(docs: DataFrame, words: int, width: int, keys: int, sets: bool = False) -> DataFrame:
    """``doc_id``, ``fp`` and ``keys`` as above but of the distinct shingles, ``same`` (a digest that only equal sets share) and, if asked for, ``shingles`` (sorted hashes, 8 bytes each)."""
    step = SLICE // 8

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                every = [shingle_set(t.as_py() or b"", words) for t in some.column(1).cast(pa.binary())]
                found = [fingerprint((h[i : i + step] for i in range(0, len(h), step)), width, keys) for h in every]
                same = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in every], pa.binary())
                held = pa.array([h.tobytes() if sets else None for h in every], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([f for f, _ in found], pa.binary()), pa.array([k for _, k in found], pa.list_(pa.int64())), same, held], names=["doc_id", "fp", "keys", "same", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp binary, keys array<long>, same binary, shingles binary")


def pigeonhole(radius: int, blocks: int) -> list[int]:
    """Masks of a 64-bit word such that fingerprints within ``radius`` bits agree under one of them: of ``blocks`` blocks, at most ``radius`` differ."""
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in some) for some in combinations(range(blocks), blocks - radius)]


def _keyed(classes: DataFrame, radius: int, blocks: int, spare: int = 0) -> DataFrame:
    """A row for each bucket of each class: ``slot``, ``key``, ``fp``, ``rep``, and ``more``, the last ``spare`` keys, if there are any."""
    if "keys" in classes.columns and spare:
        return classes.select(F.posexplode(F.slice("keys", F.lit(1), F.size("keys") - spare)).alias("slot", "key"), "fp", "rep", F.slice("keys", -spare, spare).alias("more"))
    if "keys" in classes.columns:
        return classes.select(F.posexplode("keys").alias("slot", "key"), "fp", "rep")
    word = F.conv(F.hex("fp"), 16, -10).cast("long")
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in pigeonhole(radius, blocks)])
    return classes.select("fp", "rep", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(word))).alias("slot", "key"))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``NEAR`` or more."""
    of, whole = NEAR
    # The smaller over the larger is the most that it can be.
    if whole * min(len(a), len(b)) < of * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return whole * shared >= of * (len(a) + len(b) - shared)


def merged_alike(labels: np.ndarray, i: np.ndarray, j: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """``merged``, by those pairs whose sets are alike; pairs that others join already aren't looked at."""
    step = 64
    while len(i):
        apart = labels[i] != labels[j]
        i, j = i[apart], j[apart]
        good = np.fromiter((alike(sets[a], sets[b]) for a, b in zip(i[:step], j[:step])), bool)
        labels = merged(labels, i[:step][good], j[:step][good])
        i, j, step = i[step:], j[step:], min(2 * step, 4096)
    return labels


def _forest(batches, width: int, radius: int):
    """Rows sorted by bucket in, links of each bucket's spanning forest out; where rows have their sets, only links of sets that are alike."""

    def flush(rows):
        group = np.cumsum(np.r_[False, rows["new"][1:]])
        size = np.bincount(group)
        keep = size[group] > 1
        if not keep.any():
            return None
        group, prints, rep, own = group[keep], rows["fp"][keep], rows["rep"][keep], rows["sets"][keep]
        order = np.lexsort((rep, group))
        group, prints, rep, own = group[order], prints[order], rep[order], own[order]
        labels = np.arange(len(rep))
        sets = [np.frombuffer(x, np.uint64) for x in own] if own[0] is not None else None
        for i, j in Planes(prints, group).near(radius):
            labels = merged(labels, i, j) if sets is None else merged_alike(labels, i, j, sets)
        child = labels != np.arange(len(rep))
        return pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[labels[child]])], names=["a", "b"]) if child.any() else None

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        prints = np.frombuffer(b"".join(batch.column(4).to_pylist()), ">u8").astype(np.uint64).reshape(-1, width)
        rep = batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
        sets = np.full(len(rep), None, object)
        if batch.num_columns > 6:
            sets[:] = batch.column(6).to_pylist()
        if held:
            bucket, prints, rep, sets = np.vstack([held[0], bucket]), np.vstack([held[1], prints]), np.r_[held[2], rep], np.r_[held[3], sets]
        new = np.r_[True, (bucket[1:] != bucket[:-1]).any(1)]
        last = int(np.flatnonzero(new)[-1])
        if last:
            out = flush({"new": new[:last], "fp": prints[:last], "rep": rep[:last], "sets": sets[:last]})
            if out is not None:
                yield out
        held = (bucket[last:], prints[last:], rep[last:], sets[last:])
    if held and (out := flush({"new": np.r_[True, np.zeros(len(held[2]) - 1, bool)], "fp": held[1], "rep": held[2], "sets": held[3]})) is not None:
        yield out


def _split(keyed: DataFrame, part: int) -> DataFrame:
    """Rows of buckets of over ``part`` rows in buckets by that key and one of ``more``; a common shingle brings many together that have nothing else alike."""
    hot = written(keyed.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select("slot", "key", F.lit(True).alias("hot")), "common-keys")
    if hot.isEmpty():
        return keyed.drop("more")
    marked = keyed.join(small(hot), ["slot", "key"], "left")
    again = marked.where("hot").select("slot", "key", F.posexplode("more").alias("j", "other"), "fp", "rep")
    again = again.select((F.col("slot") * 1000 + F.col("j") + 1000).alias("slot"), F.xxhash64("key", "other").alias("key"), "fp", "rep")
    return marked.where("hot is null").select("slot", "key", "fp", "rep").unionByName(again)


def links(classes: DataFrame, width: int, radius: int, blocks: int = 5, part: int = PART, spare: int = 0) -> DataFrame:
    """``a``, ``b``: links that connect all classes (``rep``, ``fp``, maybe ``keys``) within ``radius`` bits that share a bucket; ``spare`` of the keys only split large buckets."""
    keyed = _keyed(classes, radius, blocks, spare)
    return _bucket_links(_split(keyed, part) if spare else keyed, width, radius, part)


def _bucket_links(keyed: DataFrame, width: int, radius: int, part: int = PART) -> DataFrame:
    """``links`` of rows that have their bucket (``slot``, ``key``) and maybe their set (``shingles``)."""
    hot = written(keyed.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part), "hot-buckets")
    if hot.isEmpty():
        dealt = keyed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        parts = F.coalesce(F.ceil(F.col("n") / part), F.lit(1)).cast("int")
        dealt = keyed.join(small(hot), ["slot", "key"], "left").withColumn("parts", parts)
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    bucket = ["slot", "key", "i", "j"]
    dealt = dealt.select(*bucket, "fp", "rep", *[c for c in ("shingles",) if c in keyed.columns]).repartition(*bucket).sortWithinPartitions(*bucket)
    return dealt.mapInArrow(lambda batches: _forest(batches, width, radius), "a long, b long")


def _classes(docs: DataFrame, words: int, width: int, keys: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Every document's fingerprint, and each fingerprint's smallest doc_id (``rep``) with that document's keys."""
    prints = written(fingerprints(docs, words, width, keys), name)
    first = [F.min_by("keys", "doc_id").alias("keys")] if keys else []
    return prints, written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), *first), name + "-classes")


def simhash_groups(docs: DataFrame, words: int = 3, width: int = 1, radius: int = 3, blocks: int = 5, keys: int = 0, name: str = "simhash") -> DataFrame:
    """Fingerprint and component of every document.

    Two documents link if their fingerprints (64 * ``width`` bits over ``words``-word shingles) differ in at most ``radius`` bits.
    ``keys`` 0: buckets by pigeonhole over ``blocks`` blocks of a 64-bit fingerprint, so that no link is missed.
    ``keys`` over 0: buckets by that many minimum shingle hashes, for wide fingerprints and large radii: documents of
    similarity s share no bucket with probability (1 - s) ** keys.
    Returns ``doc_id``, ``fp`` (binary) and ``component_id``, the smallest doc_id reachable.
    """
    prints, classes = _classes(docs, words, width, keys, name)
    roots = components(links(classes.where("rep is not null"), width, radius, blocks), name + "-links")
    named = classes.join(roots, classes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    named = written(named, name + "-named")
    return prints.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "component_id")


#: Distinct five-word shingles in 256 bits. Of them, documents of similarity 0.8 differ in about 39, with a deviation of 6; those of four
#: and five shingles in 48. The radius only finds candidates, so it is wide; they share none of the first eight keys once in 390,000
#: times, and of the other eight, which split buckets that are large, as seldom.
WIDE = {"words": 5, "width": 4, "keys": 16}
SPARE = 8
RADIUS = 80
#: The least similarity of near copies, as a fraction: 0.8.
NEAR = (4, 5)
#: ``PART`` for rows that have their sets with them.
SET_PART = 1024


def near_duplicates(docs: DataFrame, part: int = SET_PART) -> DataFrame:
    """``node``, ``root``: documents that are copies or near copies, and the smallest doc_id of their group; roots have no row.

    Near copies have sets of five-word shingles (a shorter text is one shingle) whose Jaccard similarity is ``NEAR`` or more, and groups
    are what they connect. SimHash finds the candidates: components within ``RADIUS`` bits, by buckets of minimum hashes. Only those
    documents' sets are made once more, and compared within the component, or within the buckets again where it is larger than a part.
    Documents with a null doc_id are in no group.
    """
    prints = written(set_fingerprints(docs, **WIDE).drop("shingles"), "near-prints")
    first = [F.min_by(c, "doc_id").alias(c) for c in ("fp", "keys")]
    classes = written(prints.groupBy("same").agg(F.min("doc_id").alias("rep"), *first), "near-classes")
    copies = prints.select("doc_id", "same").join(classes.select("same", "rep"), "same").where("doc_id <> rep")
    copies = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links(classes.where("rep is not null"), WIDE["width"], RADIUS, part=2 * part, spare=SPARE), "near-candidates")
    members = written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "near-members")
    large = written(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select("root", F.lit(True).alias("large")), "near-large")
    members = members.join(small(large), "root", "left").select(F.col("node").alias("rep"), "root", F.coalesce("large", F.lit(False)).alias("large"))
    members = written(members, "near-sized")
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(members.select(F.col("rep").alias("doc_id")), 1_000_000), "doc_id", "left_semi")
    sets = set_fingerprints(again, **WIDE, sets=True).withColumnRenamed("doc_id", "rep").join(small(members, 1_000_000), "rep")
    buckets = F.when(F.col("large"), F.transform(F.slice("keys", 1, WIDE["keys"] - SPARE), lambda k, i: F.struct(i.alias("slot"), k.alias("key")))).otherwise(F.array(F.struct(F.lit(-1).alias("slot"), F.col("root").alias("key"))))
    sets = written(sets.withColumn("buckets", buckets).select("rep", "fp", "shingles", "buckets"), "near-sets")
    keyed = sets.select("rep", "fp", "shingles", F.explode("buckets").alias("at")).select("at.slot", "at.key", "fp", "rep", "shingles")
    near = _bucket_links(keyed, WIDE["width"], RADIUS, part)
    return components(written(copies.unionByName(near).distinct(), "near-links"), "near-components")


def without_near_duplicates(docs: DataFrame, part: int = SET_PART) -> DataFrame:
    """``docs`` with one row of each group of copies and near copies, that with the smallest doc_id.

    Rows are compared, not ids, so repeated rows and rows that share a doc_id or have none go like any other copies; a null doc_id
    comes after all others, and of equal doc_ids one row stays. Null texts and texts without a word are copies of each other.
    Empty table: empty result. Other columns are carried along.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    roots = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), part)
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    named = written(members.join(numbered.select(F.col(row).alias("node"), F.col("doc_id").alias("id")), "node"), "near-named")
    # One smallest row of each group, found in parts first; a group of any size costs no task more than its share.
    first = written(named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")), "near-first")
    gone = named.join(small(first, 1_000_000), "root").where(F.col("node") != F.col("first.node")).select(F.col("node").alias("__gone"))
    gone = written(gone, "near-gone")
    return numbered.join(small(gone, 1_000_000), F.col(f"`{row}`") == F.col("__gone"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
