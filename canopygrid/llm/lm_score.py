"""Stupid-backoff scores of documents under an n-gram model of the whole corpus, of triples unless the caller asks for pairs.

The score of a word after others is c(u v w) / c(u v): the count of the n-gram over that of its context, all of whose occurrences
count. Every n-gram of the corpus is in the table, so a word of the corpus itself never has to back off; asked for pairs that occur
``least`` times only, a word after another backs off to ALPHA times c(w) / N. A document begins with shorter n-grams: c(w) / N for its
first word, and c(v w) / c(v) for the second, which together are c(v w) / N.

N-grams are exploded, dealt by the hash of their context and met with their counts there: a bucket holds all n-grams of its contexts,
so both counts are made in it, and what it gives are sums by document. Contexts and n-grams that make up over 1 / ``HOT_SHARE`` of the
corpus, or occur over ``HOT_MOST`` times, are counted first and go along as tables of that proven size: hot n-grams are scored where
they are read and never dealt, other n-grams of a hot context are dealt by context and word. Words to back off to meet the unigram
table in buckets too. So no key of a bucket has more than that share of the rows. Partial sums are added up by document.

Rows are packed: a block holds the n-grams of one bucket from one batch of documents, 12 bytes each (7 of the context's hash, 5 of the
word's), so that what crosses the network stays near the size of the input; partial sums go back to their batch in blocks too, and
only there become documents again. Words are A-Z lower-cased. Words and contexts are 56-bit hashes: among a thousand million kinds, one
in 72 million shares its hash with another.

Nulls: a null text has no words; null doc_ids are one document. Rows that repeat a doc_id add up as one. Documents without words get
0 words and the score 0. Empty table: empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.common import written

ALPHA = 0.4
#: N-grams of so many words; those that occur fewer than ``LEAST`` times are not in the table: none.
ORDER, LEAST = 3, 1
#: Words and pairs are hot from one in so many of the corpus, and in any case from so many occurrences: a bucket's key has fewer rows.
HOT_SHARE, HOT_MOST = 1 << 14, 50_000_000
#: Pairs, and words of the unigram table, in a bucket on average; and how many parts of a bucket are counted one after another.
BUCKET, PARTS = 2_000_000, 4
#: Words that are hashed before a block is packed.
FLUSH = 1_000_000
SLICE = 1 << 20
#: In place of a word: nothing follows; the count of the context itself is asked for; that of a word, which stands for the context, is.
END, BEGIN, SINGLE = np.uint64(0), np.uint64(1), np.uint64(2)
FIRST_WORD = np.uint64(3)
#: Bytes of a word within its context's rows, and where words may have to be looked up.
SHORT, FULL = 5, 7
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: bytes):
    """Yield arrays of 56-bit hashes of the words of a text, a slice at a time; those below ``FIRST_WORD`` are none."""
    at = 0
    one = xxhash.xxh64_intdigest
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = text[at:end].lower().split()
        at = end
        if words:
            h = np.fromiter(map(one, words), np.uint64, len(words)) >> np.uint64(8)
            # Neither a hash nor its low bytes may look like one of the marks.
            yield h + np.where(h & np.uint64((1 << 8 * SHORT) - 1) < FIRST_WORD, FIRST_WORD, np.uint64(0))


def spread(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    x = a * _GOLD
    if b is not None:
        x = (x ^ (x >> np.uint64(29)) ^ b) * _GOLD
    return x ^ (x >> np.uint64(32))


def contexts(h: np.ndarray, order: int) -> np.ndarray:
    """56-bit hashes of all runs of ``order`` - 1 words of a text."""
    return h if order == 2 else np.maximum(spread(h[:-1], h[1:]) >> np.uint64(8), FIRST_WORD)


def packed(h: np.ndarray, size: int = FULL) -> bytes:
    """The low ``size`` bytes of each hash."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpacked(b, size: int = FULL) -> np.ndarray:
    flat = np.frombuffer(b, np.uint8)
    raw = np.zeros((len(flat) // size, 8), np.uint8)
    raw[:, :size] = flat.reshape(-1, size)
    return raw.view("<u8")[:, 0]


def _texts(batch: pa.RecordBatch, column: int):
    """Number and word hashes of each text of a batch."""
    for i, t in enumerate(batch.column(column).cast(pa.binary())):
        yield i, np.concatenate([np.empty(0, np.uint64), *word_hashes(t.as_py() or b"")])


def counts(corpus: DataFrame, keys) -> DataFrame:
    """``key``, ``n`` over the whole corpus; ``keys`` gives a text's keys from its word hashes."""

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for _, h in _texts(batch, 0):
                held.append(keys(h))
                size += len(held[-1])
                if size > FLUSH:
                    yield counted(held)
                    held, size = [], 0
            if size:
                yield counted(held)

    def counted(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return corpus.select(F.col("text").cast("string")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Hot:
    """Hot words, contexts and n-grams, sorted, with the logs of their counts."""

    def __init__(self):
        none = (np.zeros(0, np.uint64), np.zeros(0))
        self.tables = {"word": none, "context": none, "gram": none}

    def put(self, name: str, found: pa.Table) -> Hot:
        keys, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
        order = np.argsort(keys)
        self.tables[name] = keys[order], np.log(n[order])
        return self

    def find(self, name: str, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are hot, and the logs of their counts."""
        keys, values = self.tables[name]
        if not len(keys):
            return np.zeros(len(asked), bool), np.zeros(len(asked))
        i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return keys[i] == asked, values[i]

    def deal(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What decides an n-gram's bucket: its context, or both where that is hot."""
        return np.where(self.find("context", v)[0], spread(v, w), spread(v))


def hot_of(text: DataFrame, words: DataFrame, most: float, order: int, least: int) -> Hot:
    """Only pairs of hot words can be hot contexts of triples, and only n-grams whose two contexts are hot can be hot."""
    found = words.where(F.col("n") > most).toArrow()
    hot = Hot().put("word", found).put("context", found)
    if order == 3 and found.num_rows:

        def pairs(h):
            is_hot = hot.find("word", h)[0]
            return contexts(h, 3)[is_hot[:-1] & is_hot[1:]]

        hot = Hot().put("word", found).put("context", counts(text, pairs).where(F.col("n") > most).toArrow())
    if len(hot.tables["context"][0]):

        def grams(h):
            c = contexts(h, order)
            is_hot = hot.find("context", c)[0]
            return spread(c[:-1], h[order - 1 :])[is_hot[:-1] & is_hot[1:]]

        hot.put("gram", counts(text, grams).where((F.col("n") > most) & (F.col("n") >= least)).toArrow())
    return hot


BLOCK = "bucket long, batch long, ids array<long>, words array<long>, docs binary, first binary, which binary, second binary, doc binary"
_BLOCK = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5]
#: A batch's documents (``ids``, ``words``); its sums from one bucket (``docs``, ``score``, ``seen``), both with a bucket below 0; or words to look up (``docs``, ``rest``).
PARTIAL = "bucket long, batch long, ids array<long>, words array<long>, docs binary, score binary, seen binary, rest binary"
_PARTIAL = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4]


def _rows(rows: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    cells = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cells, kinds)], names=[x.split()[0] for x in schema.split(", ")])


def ascending(a: np.ndarray) -> bytes:
    return zlib.compress(np.diff(a, prepend=0).astype("<i4").tobytes(), 1)


def of_ascending(b) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(b), "<i4"), dtype=np.int64)


def _rows_of(h: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and following words of a text, what asks for its beginning first."""
    if len(h) < order - 1:
        return h, np.full(len(h), SINGLE)
    c = contexts(h, order)
    return np.r_[c[:1], c], np.r_[np.full(min(1, len(c)), BEGIN), h[order - 1 :], np.full(min(1, len(c)), END)]


def _blocks(buckets: int, hot: Hot, total: int, order: int, width: int):
    """Documents in; blocks out, and for each batch a row of its documents in a bucket of its own below 0.

    Batches are numbered by partition, so that a task that runs again gives the same ones.
    """

    def pack(batch, ids, words, v, w, doc):
        score, seen = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        rows = []
        if v:
            v, w, doc = np.concatenate(v), np.concatenate(w), np.concatenate(doc)
            # What the tables know is scored here: hot n-grams, beginnings that are hot, hot words of one-word documents; and nothing is asked of a hot last context.
            hot_v, log_v = hot.find("context", v)
            hot_gram, log_gram = hot.find("gram", spread(v, w))
            hot_gram &= hot_v & (w >= FIRST_WORD)
            begins = hot_v & (w == BEGIN)
            hot_word, log_word = hot.find("word", v)
            alone = hot_word & (w == SINGLE)
            log_total = np.log(max(1, total))
            for which, value in ((hot_gram, log_gram - log_v), (begins, log_v - log_total), (alone, log_word - log_total)):
                score += np.bincount(doc[which], value[which], len(ids))
            seen += np.bincount(doc[(hot_gram & (log_gram > 0)) | (begins & (log_v > 0) & (order > 2))], minlength=len(ids))
            left = ~(hot_gram | begins | alone | (hot_v & (w == END)))
            v, w, doc = v[left], w[left], doc[left]
            bucket = (hot.deal(v, w) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            v, w, doc, bucket = v[by], w[by], doc[by], bucket[by]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(v) else []
            for a, b in zip(cut[:-1], cut[1:]):
                first, which = np.unique(v[a:b], return_inverse=True)
                which = which.astype("<u2" if len(first) <= 65536 else "<u4")
                # Where contexts hardly repeat they are written as they come.
                if len(first) * FULL + which.nbytes < (b - a) * FULL:
                    first, which = packed(first), which.tobytes()
                else:
                    first, which = packed(v[a:b]), b""
                # N-grams lie in the order of their documents: which these are and how many each has says it all.
                there, n = np.unique(doc[a:b], return_counts=True)
                rows.append((int(bucket[a]), batch, None, None, ascending(there), first, which, packed(w[a:b], width), zlib.compress(n.astype("<u4").tobytes(), 1)))
        rows.append((-1 - batch, batch, ids, words, None, score.tobytes(), zlib.compress(seen.astype("<u4").tobytes(), 1), None, None))
        return _rows(rows, BLOCK, _BLOCK)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, words, v, w, doc, size = [], [], [], [], [], 0
        for batch in batches:
            known = batch.column(0).to_pylist()
            for i, h in _texts(batch, 1):
                if len(h):
                    c, after = _rows_of(h, order)
                    v.append(c)
                    w.append(after)
                    doc.append(np.full(len(c), len(ids), np.int32))
                ids.append(known[i])
                words.append(len(h))
                size += len(h) + 1
                if size > FLUSH:
                    yield pack(number, ids, words, v, w, doc)
                    number += 1
                    ids, words, v, w, doc, size = [], [], [], [], [], 0
        if ids:
            yield pack(number, ids, words, v, w, doc)

    return run


def _score_bucket(hot: Hot, total: int, order: int, least: int, rest_buckets: int, width: int):
    """All blocks of a bucket in; the partial scores of each block's documents out, and the words that are left to look up."""

    def part_of(rows, part):
        """The pairs of a part of the bucket: all pairs of a word, or of a pair of words, are in one part."""
        v, w, doc, base = [], [], [], 0
        for first, which, second, n in rows:
            first, second = unpacked(first), unpacked(second, width)
            a = first[np.frombuffer(which, "<u2" if len(first) <= 65536 else "<u4")] if len(which) else first
            n = np.frombuffer(zlib.decompress(n), "<u4")
            mine = (hot.deal(a, second) >> np.uint64(40)) % np.uint64(PARTS) == part
            v.append(a[mine])
            w.append(second[mine])
            doc.append(np.repeat(np.arange(base, base + len(n), dtype=np.int32), n)[mine])
            base += len(n)
        return np.concatenate(v), np.concatenate(w), np.concatenate(doc)

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            none = pa.nulls(table.num_rows, pa.binary())
            kept = [table.column(c).combine_chunks() for c in ("batch", "ids", "words", "first", "which")]
            return pa.Table.from_arrays([pa.array([-1] * table.num_rows, pa.int64()), *kept[:3], none, *kept[3:], none], names=[x.split()[0] for x in PARTIAL.split(", ")])
        # Cells are read where Arrow has them.
        rows = list(zip(*([c.as_buffer() for c in table.column(name)] for name in ("first", "which", "second", "doc"))))
        batch = table.column("batch").to_pylist()
        docs = [of_ascending(c.as_buffer()) for c in table.column("docs")]
        bounds = np.cumsum([0, *map(len, docs)])
        m = int(bounds[-1])
        sums, seens, left_w, left_d = np.zeros(m), np.zeros(m, np.int64), [], []
        for part in range(PARTS):
            v, w, doc = part_of(rows, part)
            if not len(v):
                continue
            gram = spread(v, w)
            by = np.argsort(gram, kind="stable")
            start = np.flatnonzero(np.r_[True, gram[by][1:] != gram[by][:-1]])
            size = np.diff(np.r_[start, len(gram)])
            n_gram = np.empty(len(gram), np.int64)
            n_gram[by] = np.repeat(size, size)
            _, at = np.unique(v, return_inverse=True)
            n_context = np.bincount(at, (w != BEGIN) & (w != SINGLE))[at]
            hot_v, log_v = hot.find("context", v)
            log_first = np.where(hot_v, log_v, np.log(np.maximum(1, n_context)))
            log_total = np.log(max(1, total))
            real, begins, alone = w >= FIRST_WORD, w == BEGIN, w == SINGLE
            there = real & (n_gram >= least)
            score = np.where(there, np.log(n_gram) - log_first, np.where(begins, log_first - log_total, 0.0))
            off = (real & ~there) | alone
            word = np.where(alone, v, w)
            score += np.where(off, np.where(alone, 0.0, np.log(ALPHA)) - log_total, 0.0)
            hot_w, log_w = hot.find("word", word)
            score += np.where(off & hot_w, log_w, 0.0)
            left = off & ~hot_w
            sums += np.bincount(doc, score, m)
            seens += np.bincount(doc[(real & (n_gram > 1)) | (begins & (n_context > 1) & (order > 2))], minlength=m)
            left_w.append(word[left])
            left_d.append(doc[left])
        out = [(-1, batch[k], None, None, ascending(docs[k]), sums[a:b].tobytes(), zlib.compress(seens[a:b].astype("<u4").tobytes(), 1), None) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
        word, of = np.concatenate(left_w), np.concatenate(left_d)
        block = np.searchsorted(bounds, of, "right") - 1
        bucket = (spread(word) % np.uint64(rest_buckets)).astype(np.int64)
        by = np.lexsort((of, bucket, block))
        word, of, block, bucket = word[by], of[by], block[by], bucket[by]
        cut = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]), True]) if len(word) else []
        for a, b in zip(cut[:-1], cut[1:]):
            k = int(block[a])
            out.append((int(bucket[a]), batch[k], None, None, ascending(docs[k][of[a:b] - bounds[k]]), None, None, packed(word[a:b])))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches([_rows(out, PARTIAL, _PARTIAL)])

    return run


def _look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
    """The words of a bucket that are left, met with their counts."""
    word, n = known.column("key").to_numpy().view(np.uint64), known.column("n").to_numpy()
    order = np.argsort(word)
    word, n = word[order], n[order]
    out = []
    for batch, docs, rest in zip(asked.column("batch").to_pylist(), asked.column("docs"), asked.column("rest")):
        w, d = unpacked(rest.as_buffer()), of_ascending(docs.as_buffer())
        there, at = np.unique(d, return_inverse=True)
        sums = np.bincount(at, np.log(n[np.searchsorted(word, w)]), len(there))
        out.append((-1, batch, None, None, ascending(there), sums.tobytes(), zlib.compress(np.zeros(len(there), "<u4").tobytes(), 1), None))
    return pa.Table.from_batches([_rows(out, PARTIAL, _PARTIAL)])


SCORE = "doc_id long, n_words long, n_seen long, log_score double"


def _documents(table: pa.Table) -> pa.Table:
    """All rows of a batch as its documents."""
    at = next(i for i, c in enumerate(table.column("ids")) if c.is_valid)
    ids, words = table.column("ids")[at].values, table.column("words")[at].values
    score, seen = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for docs, sums, n in zip(table.column("docs"), table.column("score"), table.column("seen")):
        if sums.is_valid:
            d = of_ascending(docs.as_buffer()) if docs.is_valid else slice(None)
            score[d] += np.frombuffer(sums.as_buffer(), np.float64)
            seen[d] += np.frombuffer(zlib.decompress(n.as_buffer()), "<u4")
    return pa.Table.from_arrays([ids, words, pa.array(seen), pa.array(score)], names=[x.split()[0] for x in SCORE.split(", ")])


def lm_scores(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_seen`` (n-grams of two words or more that the corpus has twice or more), ``log_score`` (natural, summed over the words) of every document."""
    if order not in (2, 3) or (order == 3 and least > 1):
        raise ValueError("n-grams are pairs or triples, and only pairs can be left out of the table")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = written(counts(text, lambda h: h), "lm-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # No more than total / most words, and as many contexts and n-grams, can be hot: 16384, or half a million in a corpus of 26,000 billion words.
    most = min(total / HOT_SHARE, HOT_MOST)
    hot = hot_of(text, words, most, order, least)
    # A bucket of words to look up has as many of them as one of n-grams at most: there are no more than n-grams.
    buckets = rest_buckets = max(64, -(-total // BUCKET))
    width = SHORT if least == 1 else FULL
    blocks = text.mapInArrow(_blocks(buckets, hot, total, order, width), BLOCK)
    first = written(blocks.groupBy("bucket").applyInArrow(_score_bucket(hot, total, order, least, rest_buckets, width), PARTIAL), "lm-partial")

    # The bucket of a word, as numpy has it.
    @F.arrow_udf("long")
    def bucket_of(word: pa.Array) -> pa.Array:
        return pa.array((spread(word.to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(rest_buckets)).astype(np.int64))

    asked = first.where("bucket >= 0")
    parts = first.where("bucket < 0")
    if not asked.isEmpty():
        table = words.where(F.col("n") <= most).select(bucket_of("key").alias("bucket"), "key", "n")
        parts = parts.unionByName(asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_look_up, PARTIAL))
    found = parts.groupBy("batch").applyInArrow(_documents, SCORE)
    return found.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_seen").alias("n_seen"), F.sum("log_score").alias("log_score"))


ORACLE = r"""
WITH d AS (SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS ws FROM documents),
t AS (SELECT doc_id, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
one AS (SELECT w, count(*) AS n FROM t GROUP BY w), two AS (SELECT v, w, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY v, w), three AS (SELECT u, v, w, count(*) AS n FROM t WHERE u IS NOT NULL GROUP BY u, v, w),
s AS (SELECT doc_id, coalesce(CASE WHEN t.u IS NOT NULL THEN three.n ELSE two.n END > 1, false) AS seen,
    CASE WHEN t.v IS NULL THEN ln(o.n) - ln((SELECT count(*) FROM t)) WHEN t.u IS NULL THEN ln(two.n) - ln(c.n) ELSE ln(three.n) - ln(c2.n) END AS x
  FROM t JOIN one o ON o.w = t.w LEFT JOIN one c ON c.w = t.v LEFT JOIN two ON two.v = t.v AND two.w = t.w LEFT JOIN two c2 ON c2.v = t.u AND c2.w = t.v LEFT JOIN three ON three.u = t.u AND three.v = t.v AND three.w = t.w)
SELECT d.doc_id, count(s.x) AS n_words, count(*) FILTER (WHERE seen) AS n_seen, coalesce(round(sum(x), 6), 0.0) AS log_score FROM (SELECT DISTINCT doc_id FROM d) d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
