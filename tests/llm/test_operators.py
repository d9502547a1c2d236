"""Each operator against a brute-force version, on real rows and on rows with every oddity."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from oracle import assert_same
from pyspark.sql import functions as F

from canopygrid.llm import decontamination, gam, line_dedup, lm_score, pii, quality_rules, warc
from canopygrid.llm.bitslice import Planes, merged
from canopygrid.llm.common import shared_root, written
from canopygrid.llm.components import components
from canopygrid.llm.mixing import mixed, mixed_rows, ranked, settled, targets
from canopygrid.llm.queries import ORACLE_SQL, QUERIES
from canopygrid.llm.sharding import placed, sharded
from canopygrid.llm.simhash import near_duplicates, pigeonhole, simhash_groups, without_near_duplicates

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, FOLDER), ORACLE_SQL[name], FOLDER)


@pytest.fixture(params=["sample", "edge", "none"])
def docs(request, sample_docs, edge_docs, no_docs):
    return {"sample": sample_docs, "edge": edge_docs, "none": no_docs}[request.param]


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- 1 -----------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("share", "order", "least"), [(lm_score.HOT_SHARE, lm_score.ORDER, lm_score.LEAST), (300, 3, 1), (40, 3, 1), (1, 3, 1), (300, 2, 1), (300, 2, 2), (1, 2, 3)])
def test_lm_scores(docs, monkeypatch, share, order, least):
    monkeypatch.setattr(lm_score, "HOT_SHARE", share)
    rows = [(i, tuple(words(lowered(t)))) for i, t in rows_of(docs)]
    n = Counter()
    for _, w in rows:
        for k in range(1, order + 1):
            n.update(w[i : i + k] for i in range(len(w) - k + 1))
    total, expected = sum(v for k, v in n.items() if len(k) == 1), defaultdict(lambda: [0, 0, 0.0])

    def score(context, x):
        if not context:
            return n[(x,)] / total
        if n[*context, x] >= least:
            return n[*context, x] / n[context]
        return lm_score.ALPHA * score(context[1:], x)

    for i, w in rows:
        e = expected[i]
        for k, x in enumerate(w):
            context = w[max(0, k - order + 1) : k]
            e[0] += 1
            e[1] += k > 0 and n[*context, x] > 1
            e[2] += math.log(score(context, x))
    got = lm_score.lm_scores(docs, order, least).collect()
    assert {r.doc_id for r in got} == set(expected) and len(got) == len(expected)
    for r in got:
        assert (r.n_words, r.n_seen) == tuple(expected[r.doc_id][:2]) and r.log_score == pytest.approx(expected[r.doc_id][2], rel=1e-9, abs=1e-9)


def test_packed_words():
    h = np.array([1, 2**56 - 1, 77], np.uint64)
    assert (lm_score.unpacked(lm_score.packed(h)) == h).all()
    assert (lm_score.unpacked(lm_score.packed(h, 5), 5) == h % 2**40).all()


# --- 2 -----------------------------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_line_classes(docs):
    found, occurrences = defaultdict(list), defaultdict(list)
    order = lambda o: (o[0] is None, o[0] or 0, o[1])
    for i, t in rows_of(docs):
        occurrences[i] += []
        for no, line in enumerate((t or "").split("\n")):
            if words(line):
                found[line.strip(" \t\r\x0b\x0c")].append((i, no))
                occurrences[i].append((no, line.strip(" \t\r\x0b\x0c")))
    lines = sorted(found)
    links, parent = defaultdict(set), {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    e = line_dedup.EDITS
    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            if abs(len(a) - len(b)) <= e and sum((Counter(a) - Counter(b)).values()) <= e and distance(a, b) <= min(e, max(len(a), len(b)) // line_dedup.PER_EDIT):
                links[a].add(b)
                links[b].add(a)
                parent[root(a)] = root(b)
    begin = {}
    for x in lines:
        begin[root(x)] = min([begin[root(x)]] + found[x] if root(x) in begin else found[x], key=order)
    got = {(r.doc_id): r for r in line_dedup.per_document(line_dedup.line_classes(docs)).collect()}
    assert set(got) == set(occurrences)
    for i, own in occurrences.items():
        classes = [begin[root(line)][0] for _, line in own]
        r = got[i]
        assert r.n_lines == len(own) and r.n_links == sum(len(links[line]) for _, line in own)
        assert r.n_removed == sum(begin[root(line)] != (i, no) for no, line in own)
        real = [c for c in classes if c is not None]
        assert r.class_id == (min(real) if real else None if own else i)


@pytest.mark.parametrize("split", [line_dedup.SPLIT, 4])
def test_line_links_across_hot_keys(spark, monkeypatch, split):
    """Hundreds of lines that share segments: every pair within the edits, none else."""
    monkeypatch.setattr(line_dedup, "SPLIT", split)
    base = "the quick brown fox jumps over the lazy dog and runs away from here quickly"
    lines = [base[:i] + c + base[i + 1 :] for i in range(0, 60, 3) for c in "#%&+=?"] + [base, base + "s", base[1:], "q" + base, base[:30] + base[31:]]
    lines += ["abcd", "abcde", "abxde", "abxdef", "abxyef", "aabbccddee", "aabbccddeeff", "aabccddee", "aabbccdd", "éabcd", "abc", "ab", "xbcd", "abcdefg", "abcdefgh", "bcdefgh", "acdefgh"]
    lines = sorted(set(lines))
    table = written(spark.createDataFrame(list(enumerate(lines)), "id long, line string").withColumn("chars", F.length("line")), "lines")
    got = {(r.a, r.b) for r in line_dedup.line_links(table).collect()}
    assert got == {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if distance(lines[i], lines[j]) <= min(2, max(len(lines[i]), len(lines[j])) // 5)}


def test_a_segment_that_many_lines_share(spark):
    """20,000 lines with the same first half: a second segment tells them apart, and the few links among them are found."""
    rng = np.random.default_rng(0)
    half = "this page was printed from our archive of old papers: "
    lines = [half + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 50)) for _ in range(20_000)]
    lines += [x[:70] + "#" + x[71:] for x in lines[:50]] + [x[:60] + x[61:90] + "!" + x[90:] for x in lines[50:100]]
    table = written(spark.createDataFrame(list(enumerate(lines)), "id long, line string").withColumn("chars", F.length("line")), "lines")
    assert {(r.a, r.b) for r in line_dedup.line_links(table).collect()} == {(i, 20_000 + i) for i in range(100)}


def test_deduplicated_texts(spark, edge_docs):
    out = line_dedup.deduplicated(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    texts = {r.doc_id: r.text for r in out.where("doc_id in (1, 15)").collect()}
    assert words(texts[1]) == [] and len([x for x in texts[15].split("\n") if x]) == 1


# --- 3 -----------------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    w = words(lowered(text))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs):
    rows = rows_of(docs)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    ids = sorted({i for i, _ in prints if i is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, f) in enumerate(prints):
        for j, g in prints[k + 1 :]:
            if i is not None and j is not None and (f ^ g).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    known = {f: root(i) for i, f in prints if i is not None}
    got = sorted((str(r.doc_id), bytes(r.fp).hex(), str(r.component_id)) for r in simhash_groups(docs).collect())
    assert got == sorted((str(i), f"{f:016x}", str(known.get(f))) for i, f in prints)


def test_pigeonhole_misses_none():
    masks = pigeonhole(3, 5)
    rng = np.random.default_rng(1)
    for _ in range(2000):
        flips = 0
        for b in rng.choice(64, 3, replace=False):
            flips |= 1 << int(b)
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("width,radius,sizes", [(1, 3, (1, 2, 70, 130, 64, 1)), (4, 46, (90, 3)), (1, 0, (200,)), (1, 7, (5, 500))])
def test_bit_sliced_comparison(width, radius, sizes):
    rng = np.random.default_rng(3)
    group = np.repeat(np.arange(len(sizes)), sizes)
    base = rng.integers(0, 2**64, (len(sizes), width), dtype=np.uint64)
    flips = rng.random((len(group), width, 64)) < radius / 64 / width * 0.55
    prints = base[group] ^ np.packbits(flips, axis=2, bitorder="little").view("<u8")[:, :, 0]
    got = {(int(a), int(b)) for i, j in Planes(prints, group).near(radius, most=300) for a, b in zip(i, j)}
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    assert got == {(i, j) for i in range(len(group)) for j in range(i + 1, len(group)) if group[i] == group[j] and far[i, j] <= radius}


def test_hot_bucket_in_parts(spark):
    """More near copies than a part holds."""
    from canopygrid.llm.simhash import links

    rng = np.random.default_rng(2)
    prints = [int(rng.integers(0, 2**63)) if i >= 300 else (1 << (i % 3)) | (1 << (3 + i % 50)) for i in range(600)]
    rows = [(bytes.fromhex(f"{f:016x}"), i) for i, f in {f: i for i, f in enumerate(prints)}.items()]
    classes = written(spark.createDataFrame(rows, "fp binary, rep long"), "classes")
    small, whole = ({(r.node, r.root) for r in components(links(classes, 1, 3, part=part)).collect()} for part in (16, 4096))
    assert small == whole and small


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_merged_labels():
    labels = merged(np.arange(6), np.array([5, 4, 3]), np.array([4, 3, 2]))
    assert labels.tolist() == [0, 1, 2, 2, 2, 2]


# --- 4 -----------------------------------------------------------------------------------------------------------------------------


def test_quality_rules(docs):
    got = sorted(map(str, (tuple(r) for r in quality_rules.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())))
    expected = []
    for i, t in rows_of(docs):
        w, t = words(t), t or ""
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert got == sorted(map(str, expected))


def test_line_rules(spark):
    good = "This is a plain sentence with quite a few words in it, and it ends well."
    bad = ["Home | News | About | Contact | More", "GET IT!! NOW!! BUY!! IT!!", "All rights reserved.", "Next page", "w### x$$$ y%%% z&&&", "A long line of words that goes on for a while and then just stops without any mark at all", "Home · News · About us · Contact.", "See https://a.example https://b.example https://c.example."]
    docs = spark.createDataFrame([(i, "\n".join([good] * 0 + [x])) for i, x in enumerate([good, *bad])], "doc_id long, text string")
    assert {r.doc_id: r.n_failed_lines for r in quality_rules.judged(docs).collect()} == {0: 0} | {i + 1: 1 for i in range(len(bad))}
    mixed_ = spark.createDataFrame([("\n".join([good, bad[0], "", good]),), (None,)], "text string")
    assert [r.text for r in quality_rules.cleaned(mixed_).collect()] == ["\n".join([good, "", good]), None]
    long = spark.createDataFrame([(0, "\n".join([f"{i}: {good}"[: 60 + i] + f" line {i}." for i in range(4)] + [bad[1] + f" X{i}!!" for i in range(30)])), (1, "\n".join(f"Number {' '.join(str(i * k) for k in range(30))}, it is." for i in range(4)))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules.judged(long).collect()} == {0: False, 1: True}


# --- 5 -----------------------------------------------------------------------------------------------------------------------------


def test_classifier_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op5_quality_classifier"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_classifier_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (8, 0, None), (9, None, 1), (None, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (edge_docs, no_docs):
        model = gam.learned(some, labels)
        scores = some.select("doc_id", gam.score_of(F.col("text"), model).alias("score")).collect()
        assert len(scores) == some.count() and all(0 <= r.score <= 1 for r in scores)
    none = gam.learned(edge_docs, labels.limit(0))
    assert {r.score for r in edge_docs.select(gam.score_of(F.col("text"), none).alias("score")).collect()} == {0.5}


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9 and (0, 1) in model.pair


@pytest.mark.parametrize("slice_", [7, 100, 1000])
def test_features_of_slices(monkeypatch, slice_):
    """Every feature is that of the whole text, wherever it is cut."""
    rng = np.random.default_rng(1)
    known = ["some", "words", "here.", "x", "much-longer-words-than-others", "Ünd", "!!", "|"]
    texts = ["some words here. " * 400, "\n".join(" ".join(rng.choice(known, rng.integers(0, 9))) for _ in range(300)), "", "\n\n \n", "x" * 3000, "no end\n", " \t\r\n".join(known * 40)]
    whole = [gam.features(t.encode()) for t in texts]
    monkeypatch.setattr(gam, "SLICE", slice_)
    for t, expected in zip(texts, whole):
        assert gam.features(t.encode()) == pytest.approx(expected), t[:40]
    w, rows = texts[1].split(), [x for x in texts[1].split("\n") if x.strip()]
    at = dict(zip(gam.FEATURES, gam.features(texts[1].encode())))
    assert at["new_words"] == pytest.approx(len(set(w)) / len(w)) and at["new_pairs"] == pytest.approx(len(set(zip(w, w[1:]))) / (len(w) - 1))
    assert at["line_repeats"] == pytest.approx(1 - len(set(rows)) / len(rows)) and at["short_lines"] == pytest.approx(sum(len(x.encode()) < 40 for x in rows) / len(rows))


def test_scores_are_sums_of_the_tables(sample_docs):
    """The learned tables added up by hand, bin by bin, for every document; nothing but the labels that aren't held out shapes them."""
    labels = sample_docs.sparkSession.read.parquet(f"{FOLDER}/labels.parquet")
    model = gam.learned(sample_docs, labels)
    for doc_id, text, score in sample_docs.select("doc_id", "text", gam.score_of(F.col("text"), model).alias("s")).collect():
        x = gam.features((text or "").encode())
        total = model.base
        for j, v in enumerate(x):
            total += model.main[j][sum(e < v for e in model.edges[j])]
        for (i, j), table in model.pair.items():
            total += table[sum(e < x[i] for e in model.coarse[i]), sum(e < x[j] for e in model.coarse[j])]
        assert score == pytest.approx(1 / (1 + math.exp(-total))), doc_id
    others = labels.withColumn("quality", F.when(gam.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = gam.learned(sample_docs, others)
    assert again.base == model.base and all((a == b).all() for a, b in zip(again.main, model.main)) and again.pair.keys() == model.pair.keys()


def test_learning_takes_a_row_for_each_id(spark):
    rows = [(i % 40, " ".join(["good" if i % 2 else "BAD!"] * (5 + i % 7))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, quality int")
    few = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    a, b = gam.learned(docs, labels), gam.learned(few, labels)
    assert a.base == pytest.approx(b.base)


# --- 6 -----------------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        left, w = goal - sum(2 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        level = left / w if w else 0
        more = {s for s in order if s not in full and level * weight[s] >= 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= more


def test_mixing(docs):
    rows = docs.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    got = mixed(docs).collect()
    key = lambda i, s, n: (str(i), str(s), n)
    assert sorted(key(r.doc_id, r.source, r.size) for r in got) == sorted(key(r.doc_id, r.source, len(words(r.text))) for r in rows)
    if not rows:
        return
    expected = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source]) and 0 <= r.copies <= 2
        rate = r.target / r.source_size if r.source_size else 0
        assert math.floor(rate) <= r.copies <= math.floor(rate) + 1
    again = mixed(docs.repartition(7)).collect()
    said = lambda rows: sorted(map(str, ((r.doc_id, r.source, r.size, r.target, r.copies) for r in rows)))
    assert said(got) == said(again)


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.lognormal(4, 1))), f"s{i % 5}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixed(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.02 for r in taken)


@pytest.mark.parametrize("n", [1, 2, 7, 63])
def test_rounding_is_as_by_hand(spark, n):
    """Groups of one node folded by hand, with the same random numbers: copies of every document, and none but the last fraction is drawn alone."""
    rng = np.random.default_rng(n)
    p, u = rng.random(n).round(6), rng.random(n).round(6)
    items = spark.createDataFrame([([(float(a), float(b), i) for i, (a, b) in enumerate(zip(p, u))],)], "items array<struct<p: double, u: double, i: int>>")
    got = items.select(settled(F.col("items")).alias("r")).first().r
    expected, cur = {}, (p[0], 0)
    for i in range(1, n):
        a, b = cur[0], p[i]
        if a + b < 1:  # the loser gets nothing, the winner all
            first = u[i] * (a + b) >= b
            expected[i if first else cur[1]] = 0
            cur = (a + b, cur[1] if first else i)
        else:  # the winner is taken, the loser keeps the rest
            first = u[i] * (2 - a - b) >= 1 - b
            expected[i if first else cur[1]] = 1
            cur = (a + b - 1, cur[1] if first else i)
    assert {o.item.i: o.copies for o in got.out} == expected
    assert (got.cur.i, got.cur.p) == (cur[1], pytest.approx(cur[0]))
    assert sum(expected.values()) + cur[0] == pytest.approx(p.sum())


def test_sources_are_numbered_by_code_point(spark):
    names = [f"s{i}" for i in range(300)] + ["Z", "z", "é", "😀", "", None]
    rows = ranked(spark.createDataFrame([(x, 1) for x in names], "source string, source_size long").repartition(5)).collect()
    order = sorted((x for x in names if x is not None), key=lambda x: x.encode()) + [None]
    assert sorted((r["rank"], order.index(r.source)) for r in rows) == [(i, i) for i in range(len(order))]


def test_mixed_rows(spark, edge_docs):
    counts = Counter({(r.doc_id, r.source, r.size): 0 for r in mixed(edge_docs).collect()})
    for r in mixed(edge_docs).collect():
        counts[r.doc_id, r.source, r.size] += r.copies
    out = mixed_rows(edge_docs)
    assert out.columns == edge_docs.columns
    assert Counter((r.doc_id, r.source, len(words(r.text))) for r in out.collect()) == +counts


def test_targets_reshare(spark):
    table = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in targets(table).collect()}
    assert got == pytest.approx(brute_targets({"a": 10, "b": 1000, "c": 500, None: 0})) and sum(got.values()) == pytest.approx(1.5 * 1510)


# --- 7 -----------------------------------------------------------------------------------------------------------------------------


def test_every_pair_within_the_radius_meets():
    patterns = set(decontamination.block_patterns())
    rng = np.random.default_rng(0)
    for _ in range(500):
        flips = 0
        for b in rng.choice(64, decontamination.RADIUS, replace=False):
            flips |= 1 << int(b)
        assert any(flips >> 8 * k & 255 in patterns for k in range(8))


def _items(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and so on to the end of all."
    return passage, spark.createDataFrame([(1, passage), (2, "too short here"), (3, None), (None, " ".join(f"w{i}" for i in range(30))), (5, " ".join(["again and"] * 12)), (6, "Zweiundvierzig"), (7, "?!")], "item_id long, text string")


@pytest.mark.parametrize("literals", [decontamination.LITERALS, 3])
def test_leaks(spark, edge_docs, monkeypatch, literals):
    monkeypatch.setattr(decontamination, "LITERALS", literals)
    passage, items = _items(spark)
    w = passage.split()
    filler = " ".join(f"f{i}" for i in range(200))
    planted = {50: f"{filler} {passage} {filler}", 51: passage.upper().replace(" ", "  ") + "!", 52: f"{filler} {' '.join(w[:-2])}", 53: f"{filler} {' '.join(w[:15])} {filler}", 54: " ".join(f"w{i}" for i in range(30)), 55: "again and " * 30}
    planted |= {56: f"{filler} Too short, HERE {filler}", 57: "too short here", 58: f"{filler} zweiundvierzig", 59: "too short", 60: "here too short"}
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(planted.items()), "doc_id long, text string"))
    found = decontamination.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(50, 1), (51, 1), (52, 1), (54, None), (55, 5), (56, 2), (57, 2), (58, 6)}
    assert {r.doc_id: r.start for r in found if r.item_id == 1} == {50: 200, 51: 0, 52: 198}
    assert all(r.similarity == 1 for r in found if r.doc_id != 52)
    kept = decontamination.without_leaks(docs, items)
    assert kept.count() == docs.count() - 8 and kept.columns == docs.columns


def test_leaks_against_all_windows(spark):
    """Edited passages against windows at every place, not only where a shingle puts them, and without SimHash: what is found and what is missed."""
    rng = np.random.default_rng(3)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").limit(40).collect()]
    said = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    texts = []
    for item, text in items:
        for edits in range(4):
            w = said(text)
            for _ in range(edits):
                at = int(rng.integers(0, len(w)))
                w[at : at + 1] = [["changed"], [], [w[at], "more"]][int(rng.integers(0, 3))]
            texts.append((len(texts), item, " ".join([f"f{k}" for k in range(20)] + w + [f"g{k}" for k in range(20)])))
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    expected = {}
    by_item = {i: said(t) for i, t in items}
    for d, item, text in texts:
        own, w = bag(by_item[item]), said(text)
        n = sum(own.values())
        best = max((lambda s: s / (2 * n - s))(sum((own & bag(w[k : k + n + 4])).values())) for k in range(len(w) - n - 3))
        if best >= 0.8:
            expected[d, item] = best
    docs = spark.createDataFrame([(d, t) for d, _, t in texts], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    own = {k: v for k, v in got.items() if k[1] == texts[k[0]][1]}
    assert len(expected) > 40 and set(own) <= set(expected)
    assert len(own) >= 0.98 * len(expected) and sum(v == pytest.approx(expected[k]) for k, v in own.items()) >= 0.98 * len(own)


def test_leaks_between_the_places_of_shingles(spark):
    """A passage with a new first and last word and seven more inside: of all windows only those that begin a little later reach 0.8."""
    w = [f"w{k}" for k in range(104)]
    passage = ["new", *w[1:50], *[f"more{k}" for k in range(7)], *w[50:103], "other"]
    docs = [(1, " ".join([f"f{k}" for k in range(30)] + passage + [f"g{k}" for k in range(30)])), (2, " ".join(passage)), (3, " ".join(["again and"] * 40))]
    items = [(1, " ".join(w)), (2, " ".join(["again and"] * 12))]
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.start, r.shared, round(r.similarity, 6)) for r in found.collect()) == [(1, 1, 31, 89, round(89 / 111, 6)), (2, 1, 1, 89, round(89 / 111, 6)), (3, 2, 0, 20, 1.0)]


def test_every_window_that_can_reach_the_similarity(spark):
    rng = np.random.default_rng(8)
    cases = []
    for _ in range(300):
        n, m = int(rng.integers(1, 60)), int(rng.integers(1, 40))
        cases.append((n, m, sorted(int(p) for p in np.flatnonzero(rng.random(n) < rng.random()))))
    for least in (0.8, 0.5, 0.0):
        rows = spark.createDataFrame(cases, "n int, m int, places array<int>").select("*", decontamination.able(F.col("places"), F.col("n"), F.col("m"), least).alias("starts")).collect()
        for r in rows:
            w = min(r.n, r.m)
            held = [sum(s <= p < s + w for p in r.places) for s in range(r.n - w + 1)]
            assert r.starts == [s for s, h in enumerate(held) if h and h / (w + r.m - h) >= least]


def test_leaks_of_nothing(spark, no_docs, edge_docs):
    _, items = _items(spark)
    assert decontamination.leaks(no_docs, items).isEmpty() and decontamination.leaks(edge_docs, items.limit(0)).isEmpty()
    assert decontamination.without_leaks(edge_docs, items.limit(0)).count() == edge_docs.count()


# --- 8 -----------------------------------------------------------------------------------------------------------------------------


def test_shards(docs):
    rows = rows_of(docs)
    got = sharded(docs, 24).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in got))) == sorted(map(str, ((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    if rows:
        counts = [len(slots.get(s, [])) for s in range(24)]
        assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharded(docs.repartition(5), 24).collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, map(tuple, got)))


def test_bounded_loads_walk_the_ring(spark):
    """The plan against a walk by hand: every cell's rows go to the next node with room, in rounds."""
    cells = {int(c): int(n) for c, n in zip(np.random.default_rng(0).choice(1 << 16, 300, replace=False), np.random.default_rng(1).integers(1, 50, 300))}
    from canopygrid.llm.sharding import ring

    nodes = sorted((r.cell, r.shard) for r in ring(spark, 5, 16).collect())
    total = sum(cells.values())
    room = {s: total // 5 + (s < total % 5) for s in range(5)}
    pending, taken = [(c, 0, n) for c, n in sorted(cells.items())], Counter()
    expected = set()
    while pending:
        full = {s for s in room if taken[s] >= room[s]}
        asks = defaultdict(list)
        for c, low, n in pending:
            after = [x for x in nodes if x[1] not in full]
            shard = next((s for p, s in after if p >= c), after[0][1])
            asks[shard].append((c, low, n))
        pending = []
        for s, some in asks.items():
            for c, low, n in some:
                k = min(n, room[s] - taken[s])
                if k:
                    expected.add((c, low, k, s, taken[s]))
                    taken[s] += k
                if k < n:
                    pending.append((c, low + k, n - k))
        pending.sort()
    table = spark.createDataFrame(list(cells.items()), "cell int, n long")
    assert {tuple(r) for r in placed(table, 5, 0.0, 16).select("cell", "low", "n", "shard", "base").collect()} == expected
    loose = placed(table, 5, 0.25, 16).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in loose) == total and max(r.n for r in loose) <= math.ceil(1.25 * total / 5)


def test_masses_of_equal_rows_are_split(spark, monkeypatch):
    """100,000 rows of one null id and one text: nothing is numbered or rounded in one piece, and the laws hold."""
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same few words").alias("text"), F.lit("s").alias("source"))
    docs = docs.unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("other words "), F.col("id").cast("string")).alias("text"), F.lit("t").alias("source"))).repartition(4)
    rows = sharded(docs, 24).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("top")).collect()
    assert len(rows) == 24 and all(r.n == r.slots == r.top + 1 for r in rows) and max(r.n for r in rows) - min(r.n for r in rows) <= 1 and sum(r.n for r in rows) == 103_000
    mix = mixed(docs).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("copies").alias("most"), F.max("target").alias("target")).collect()
    assert sorted(r.n for r in mix) == [3000, 100_000]
    assert all(abs(r.taken - r.target) <= 4 and r.most <= 2 for r in mix)


def test_a_new_shard_takes_little_else_along(sample_docs):
    """With slack, adding a shard moves about its share; keys that stay in a shard with room don't move."""
    place = lambda n: {r.doc_id: r.shard for r in sharded(sample_docs.dropDuplicates(["doc_id"]), n, slack=0.25, virtual_nodes=512).collect()}
    a, b = place(8), place(9)
    moved = [i for i in a if a[i] != b[i]]
    assert len(moved) < 0.4 * len(a) and sum(b[i] == 8 for i in moved) >= 0.4 * len(moved)


# --- 9 -----------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [warc.CHUNK, 5_000, 997])
def test_warc_round_trip(spark, tmp_path, piece):
    long, big = "<p>same\r\nbody\n</p>" * 100, "é\n" * 400_000
    rows = [(1, "http://a/1", long), (2, None, long), (3, "http://a/ b\nc", long + "x"), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", big), (9, "u", big), (2, None, long), (None, "u", "no id"), (10, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 50), (11, "u", "ends\n"), (12, "u", "\n\n"), (13, "u", "no feed " * 4_000), (14, "u", "a\r\n" + "0\r" * 9_000 + "\n"), (15, "u", "x" * 5_000), (16, "u", "x" * 4_999 + "\n" + "y" * 997 + "\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "top": F.lit(2), "payload": F.lit(3)}).repartition(3)
    warc.write_warc(pages, str(tmp_path / "w"), chunk=piece)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path / "w")).agg(F.max(F.octet_length("value"))).first()[0] <= piece + 10
    chunks = warc.read_warc(spark, str(tmp_path / "w"), chunk=10_000).collect()
    bodies = defaultdict(bytes)
    for r in sorted(chunks, key=lambda r: (r.record_id, r.record_type, r.chunk_no)):
        if r.record_type == "response" and r.page_id != 2:  # of which there are two
            bodies[r.page_id] += r.data
            assert len(r.data) <= 10_000 and r.sha1_so_far == hashlib.sha1(bodies[r.page_id]).hexdigest() and r.bytes_so_far == len(bodies[r.page_id])
    top = {}
    for i, _, h in rows:
        top[h] = max(top.get(h, i) or -1, i or -1)
    expected = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and top[h] != i
        expected.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[h] if again else None))
        if not again and i not in (2,):
            assert bodies[i] == b
    got = [(r.page_id, r.bytes_so_far, r.sha1_so_far, r.record_type, r.refers_to) for r in chunks if r.last]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    empty = str(tmp_path / "e")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).isEmpty()


def test_long_line_is_never_held_whole():
    """A payload of 50 MB without a line feed is written and read in lines and chunks of a MiB, in a few times their memory."""
    import tracemalloc

    import pyarrow as pa

    text = pa.array([b"x" * 50_000_000], pa.binary())
    digest = hashlib.sha1(text[0].as_py()).hexdigest()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["u"]), text, pa.array([digest]), pa.array([None], pa.int64())], names=list("abcde"))
    tracemalloc.start()
    reader, size, last = warc._Reader(warc.CHUNK, True), 0, []
    for lines in warc._lines(warc.CHUNK)([batch]):
        for line in lines.column(0):
            assert len(line.as_py()) <= warc.CHUNK + 10
            reader.line(line.as_py())
            size += sum(len(r[6]) for r in reader.rows)
            last, reader.rows = reader.rows[-1:] or last, []
    assert tracemalloc.get_traced_memory()[1] < 30_000_000 and size == 50_000_000 and last[0][7] == digest
    tracemalloc.stop()


def test_damaged_record_fails():
    reader = warc._Reader(100, True)
    head, http = warc._head(1, "u", hashlib.sha1(b"abc").hexdigest(), 3, None)
    with pytest.raises(ValueError, match="damaged"):
        for line in (head + http + b"abd\r\n\r\n").split(b"\n")[:-1]:
            reader.line(line)


def test_warc_query(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op9_warc_round_trip"](spark, FOLDER).collect()}
    assert len(got) == len(pages) and all(got[p.page_id].payload_digest == hashlib.sha1(p.html.encode()).hexdigest() for p in pages)


# --- 10 ----------------------------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    out = [(m.start(), 0, f"email:{m.start()}:{m.end()}") for m in EMAIL.finditer(text)] if "@" in text else []
    out += [(m.start(), 1, f"ip:{m.start()}:{m.end()}") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        check = sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and check % 10 == 0:
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    out += [(m.start(), 3, f"phone:{m.start()}:{m.end()}") for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [s for _, _, s in sorted(out)]


TRICKY = "a@b.c x@@y.z a@b@c.de .@-.- me@mail.example.com.@x.y 1.2.3.4.5 256.1.1.1 01.002.03.4 4111 1111 1111 1111 4111-1111-1111-1111-2 +1 (555) 123-4567. +49-30-1234 +12 é😀 joe@ex.org +1234567890123456789 0.0.0.0"


def test_personal_data(spark, docs):
    rows = rows_of(docs) + [(900, TRICKY), (901, TRICKY * 50)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[-2:], "doc_id long, text string"))
    got = pii.digest(pii.found(more)).collect()
    said = sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got)
    expected = []
    for i, t in rows:
        base = brute_base(t or "")
        kinds = Counter(s.split(":")[0] for s in base)
        expected.append((str(i), hashlib.sha256(",".join(base).encode()).hexdigest(), *(kinds[k] for k in pii.BASE)))
    assert said == sorted(expected)
    for r in got:
        assert set(brute_base(dict(rows).get(r.doc_id) or "")) <= set(r.spans.split(",")) | {""} or r.doc_id is None


HOSTILE = {"schemes": "http://" * 150_000, "closed": "http://a.b/" + ")" * 10**6, "dots in hosts": "ftp://....." * 100_000, "digits": "1" * 10**6, "parts": "1." * 500_000, "dashes": "1-" * 500_000, "ats": "a@" * 500_000, "secrets": "secret=" * 150_000, "phone": "+1" + " " * 10**6}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_texts_take_time_in_proportion(name):
    a, text = pii.automaton(), HOSTILE[name]
    began = time.perf_counter()
    pii.spans(text, a)
    assert time.perf_counter() - began < 15


def test_added_spans():
    a = pii.automaton()
    at = lambda text: [(k, text[s:e]) for k, s, e in pii.spans(text, a) if k in pii.ADDED]
    assert at("see https://a.example.org/x?y=1). now") == [("url", "https://a.example.org/x?y=1")]
    assert at("IBAN: DE89 3704 0044 0532 0130 00, thanks") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert at("IBAN DE00 3704 0044 0532 0130 00") == []
    assert at("SSN is 123-45-6789.") == [("ssn", "123-45-6789")]
    assert at('token = "ab12cd34ef56ab12cd34"') == [("secret", "ab12cd34ef56ab12cd34")]
    assert at("account no. 12345678 and accounting") == [("account", "12345678")]
    assert pii.redacted("write to joe@ex.org now", a) == "write to [EMAIL] now"


# --- the shared parts --------------------------------------------------------------------------------------------------------------


def test_shared_folder_is_the_sessions(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_near_duplicates_find_copies_and_near_copies(edge_docs):
    assert {(r.node, r.root) for r in near_duplicates(edge_docs).collect() if r.node in (1, 2, 13, 100)} == {(1, 0), (2, 0), (13, 0), (100, 0)}


@pytest.mark.parametrize("options", [{}, {"part": 4}])
def test_near_duplicates_are_those_of_similarity(spark, options):
    """Groups are the components of all pairs of Jaccard similarity 0.8 or more over five words, and of no others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    base = [f"w{i}" for i in range(60)]
    made = [base, base[:30] + ["x"] + base[31:], [*base[:15], "y", *base[16:40], "y", *base[41:]], base[:8], base[:9], base[:7], ["one"], ["one", "two"]]
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string"))
    sets, met = {}, defaultdict(set)
    for i, text in rows_of(docs):
        w = words(lowered(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
        for s in sets[i]:
            met[s].add(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        shared = Counter(b for s in sets[a] for b in met[s] if b > a)
        for b, n in shared.items():
            if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    got = {r.node: r.root for r in near_duplicates(docs, **options).collect()}
    assert got == {i: root(i) for i in sets if root(i) != i}
    assert got[10**6 + 1] == 10**6 and got[10**6 + 4] == 10**6 + 3 and 10**6 + 2 not in got


def test_near_duplicates_go_by_row(spark):
    """Copies with repeated or null ids go like others; the smallest doc_id stays, null last, with its columns."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, 0), (1, text, 1), (2, text, 2), (1, text, 3), (None, text, 4), (7, "something else", 5), (None, "of its own", 6), (9, None, 7), (8, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(4)
    got = without_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = sorted(got.collect(), key=str)
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "of its own"), (1, text), (7, "something else"), (8, "")]
    assert all(tuple(r) in rows for r in kept)
