"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns a lookup table for each feature, and for the pairs of features that help most a table over
both. A score is the sigmoid of a sum of table entries, found for a whole Arrow batch at once.

The model learns from a bounded sample of labelled rows (``MAX_TRAIN``), drawn by hash over all of them; everything else covers all rows.
Nulls: a null text counts as empty; a null label is no label; a null doc_id is held out. No label of one kind: every score is the
share of the other kind, 0.5 without any label. Repeated rows score alike; of rows that share a doc_id, and of labels that do, one
counts for learning. Very long texts have the same features as short ones. Empty table: empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that the model is fitted on.
MAX_TRAIN = 20_000
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 160, 60, 6
RATE, RIDGE = 0.15, 4.0
THRESHOLD = 0.3
SLICE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_END = np.frombuffer(b".!?;:", np.uint8)
FEATURES = ("log_words", "word_bytes", "symbols", "exclaims", "bars", "upper", "digits", "lines", "line_repeats", "new_words", "new_pairs", "ends", "commas", "entropy", "wide", "short_lines", "quotes", "new_bytes")


class _Distinct:
    """How many different byte strings were added, a set of them at a time; of more than one set only 64-bit hashes are kept."""

    def __init__(self):
        self.first, self.hashes = None, []

    def add(self, some: set) -> None:
        if self.first is None and not self.hashes:
            self.first = some
            return
        if self.first is not None:
            self.hashes.append(self._hashed(self.first))
            self.first = None
        self.hashes.append(self._hashed(some))

    @staticmethod
    def _hashed(some: set) -> np.ndarray:
        return np.unique(np.fromiter((xxhash.xxh64_intdigest(x if isinstance(x, bytes) else b" ".join(x)) for x in some), np.uint64, len(some)))

    def count(self) -> int:
        return len(self.first or ()) if not self.hashes else len(np.unique(np.concatenate(self.hashes)))


def _slices(text: bytes):
    """The text in slices that end at a space of any kind; only a longer word makes a longer slice."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def features(text: bytes) -> list[float]:
    """The features of one text, over the whole of it, whatever its length.

    A slice of the text is split at a time. Distinct words, pairs and lines are those of the whole text, told apart by 64-bit hashes
    from the second slice on, which take no more memory than the text.
    """
    count = np.zeros(256, np.int64)
    n = pairs = lines = short = 0
    words_seen, pairs_seen, lines_seen = _Distinct(), _Distinct(), _Distinct()
    last: list[bytes] = []
    begun: list[bytes] = []
    for part in _slices(text):
        count += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words = part.split()
        n += len(words)
        words_seen.add(set(words))
        words = last + words
        pairs += max(0, len(words) - 1)
        pairs_seen.add(set(zip(words, words[1:])))
        last = words[-1:]
        first, *rows = part.split(b"\n")
        begun.append(first)
        if rows:
            rows = [b"".join(begun), *rows]
            begun = [rows.pop()]
        rows = [x for x in rows if x.strip()]
        lines += len(rows)
        short += sum(len(x) < 40 for x in rows)
        lines_seen.add(set(rows))
    if (rest := b"".join(begun)).strip():
        lines += 1
        short += len(rest) < 40
        lines_seen.add({rest})
    new, new_pairs, new_lines = words_seen.count(), pairs_seen.count(), lines_seen.count()
    w, letters = max(1, n), max(1, int(count[65:91].sum() + count[97:123].sum()))
    share = count[count > 0] / max(1, len(text))
    return [
        float(np.log1p(n)), float(count.sum() - count[[32, 9, 10, 11, 12, 13]].sum()) / w, count[_SYMBOLS].sum() / w, count[33] / w, count[124] / w, count[65:91].sum() / letters,
        count[48:58].sum() / w, lines / w, 1 - new_lines / max(1, lines), new / w, new_pairs / max(1, pairs), count[_END].sum() / w, count[44] / w, float(-(share * np.log2(share)).sum()),
        count[128:].sum() / max(1, len(text)), short / max(1, lines), (count[34] + count[39]) / w, float((count > 0).sum()) / 256,
    ]


@dataclass
class Gam:
    """Bin edges of each feature, and the tables: ``main[j][bin]`` and ``pair[(i, j)][bin_i, bin_j]``."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    main: list[np.ndarray] = field(default_factory=list)
    pair: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.main):
            out += table[np.searchsorted(self.edges[j], x[:, j], "left")]
        for (i, j), table in self.pair.items():
            out += table[np.searchsorted(self.coarse[i], x[:, i], "left"), np.searchsorted(self.coarse[j], x[:, j], "left")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of one cut over bins, and the first bin to its right."""
    if len(g) < 2:
        return 0.0, len(g)
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    won = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(won))
    return float(won[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of a shallow tree over the bins of one feature."""
    won, at = _cut(g, h)
    if not depth or won <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.r_[_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)]


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree that cuts the first feature, then each side by the second."""
    out, best = np.zeros_like(g), -1.0
    for at in range(1, len(g)):
        won, parts = 0.0, []
        for rows in (slice(0, at), slice(at, len(g))):
            a, b = g[rows].sum(0), h[rows].sum(0)
            gain, cut = _cut(a, b)
            won += gain + _gain(a.sum(), b.sum())
            parts.append((rows, cut, a, b))
        if won > best:
            best = won
            for rows, cut, a, b in parts:
                out[rows, :cut] = a[:cut].sum() / (b[:cut].sum() + RIDGE)
                out[rows, cut:] = a[cut:].sum() / (b[cut:].sum() + RIDGE)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Boost main effects in turn, pick the pairs whose tree gains most on the rest, boost these in turn."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Gam(base=float(np.log(share / (1 - share))))
    model = Gam(base=float(np.log(y.mean() / (1 - y.mean()))))
    d = x.shape[1]
    model.edges, model.coarse = [_edges(x[:, j], BINS) for j in range(d)], [_edges(x[:, j], PAIR_BINS) for j in range(d)]
    fine = [np.searchsorted(model.edges[j], x[:, j], "left") for j in range(d)]
    rough = [np.searchsorted(model.coarse[j], x[:, j], "left") for j in range(d)]
    model.main = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            step = RATE * _tree(np.bincount(fine[j], g, len(model.main[j])), np.bincount(fine[j], h, len(model.main[j])))
            model.main[j] += step
            total += step[fine[j]]

    def table(i, j, g, h):
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        at = rough[i] * shape[1] + rough[j]
        return _pair_tree(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape))

    g, h = slopes()
    gains = sorted(((table(i, j, g, h)[0], i, j) for i, j in combinations(range(d), 2)), reverse=True)
    model.pair = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for _, i, j in gains[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), values in model.pair.items():
            g, h = slopes()
            step = RATE * table(i, j, g, h)[1]
            values += step
            total += step[rough[i], rough[j]]
    return model


def matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py() or b"") for t in texts.cast(pa.binary())], np.float64).reshape(-1, len(FEATURES))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN) -> Gam:
    """Fit on the labelled rows of ``docs`` that are not held out, at most ``most`` of them, drawn by hash."""
    named = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    once = named.groupBy("id").agg(F.min("y").alias("y"))
    # Those with a low hash, about a tenth more than needed, are sorted; so what meets in one task doesn't grow with the labels.
    upto = int(min(1.0, 1.1 * most / max(1, named.count())) * 2**32)
    sample = once.where(order <= upto).orderBy(order, "id").limit(most)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(matrix(batch.column(2))), pa.list_(pa.float64()))], names=["id", "y", "x"])

    # The sample, and with it the broadcast and what the driver gets, is bounded by ``most``: one row for each id, however often it is there.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text").mapInArrow(run, "id long, y int, x array<double>")
    found = sorted((r.id, r.y, r.x) for r in rows.groupBy("id", "y").agg(F.min("x").alias("x")).collect())
    return fit(np.array([x for _, _, x in found]).reshape(-1, len(FEATURES)), np.array([y for _, y, _ in found], np.float64))


def score_of(text: Column, model: Gam) -> Column:
    """The score of each text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(texts)))

    return score(F.coalesce(text.cast("string"), F.lit("")))
