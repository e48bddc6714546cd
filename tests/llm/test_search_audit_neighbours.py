"""Ranked search, divergence audit and nearest neighbours against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellpath.llm import divergence, lexical, neighbours

DOCS = "doc_id long, text string, lang string, source string"


def texts(seed, n, words=40):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    chance = 1 / np.arange(1, words + 1)
    return [" ".join(rng.choice(vocabulary, rng.integers(0, 30), p=chance / chance.sum())) for _ in range(n)]


# Ranked lexical search.

def plain_search(docs, items, top=10):
    """Every document scored by the formula."""
    def terms(text):
        return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())

    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item, text in items:
        scores = []
        for doc, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if c[t])
            if score:
                scores.append((-score, doc is None, doc or 0))
        found += [(item, rank, None if none else doc, -score)
                  for rank, (score, none, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(found, key=repr)


def search(spark, docs, items):
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id string, text string"))
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("leaf, shard, block", [(1, 16_384, 200_000), (2, 37, 200_000), (128, 16_384, 40)])
def test_search_finds_the_best_of_all_documents(spark, monkeypatch, leaf, shard, block):
    for name, value in (("LEAF", leaf), ("SHARD_DOCS", shard), ("BLOCK_TERMS", block), ("STEP", 3)):
        monkeypatch.setattr(lexical, name, value)
    docs = list(enumerate(texts(1, 300)))
    docs += [(1000, None), (1001, ""), (1002, " .,-"), (1003, "W1 w2 " * 9000), (None, docs[5][1]), (5, docs[5][1]),
             (1004, "ñandú w3 Ñandú"), (1005, "only-once")]
    items = [(f"i{k}", t) for k, t in enumerate(texts(2, 25))]
    items += [("none", None), ("empty", ""), ("rare", "only ñandú ÑANDÚ"), ("twice", "w1 W1 w1"), ("unknown", "zzz"), (None, "w7")]
    assert search(spark, docs, items) == plain_search(docs, items)


def test_equal_scores_come_by_id_and_tables_may_be_empty(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(77, "something else")]
    got = search(spark, docs, [("q", "words")])
    assert [(r[1], r[2]) for r in sorted(got, key=lambda r: r[1])] == [(k, k) for k in range(1, 11)]
    assert search(spark, [], [("q", "words")]) == [] == search(spark, docs, [])
    wide = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, row long, n long, terms long")
    asked = spark.createDataFrame([("q", "b", 1, 2)], "item_id string, text string, row long, rank long")
    assert [r.doc_id for r in lexical.search(wide, asked).collect()] == [1]


def test_range_maxima_equal_those_of_slices():
    rng = np.random.default_rng(0)
    docs, terms = 60, 5
    owner = np.repeat(np.arange(docs), terms)
    kept = rng.random(len(owner)) < 0.6
    shard = lexical.Shard(np.arange(docs), np.full(docs, 5), owner[kept], np.tile(np.arange(1, terms + 1), docs)[kept].astype(np.int32),
                          rng.integers(1, 9, kept.sum()), np.full(terms + 1, 1000), docs, docs * 5)
    begin = rng.integers(0, len(shard.keys), 400)
    end = np.array([rng.integers(b, np.searchsorted(shard.keys, (shard.keys[b] // docs + 1) * docs) + 1) for b in begin])
    found = shard.largest(begin, end)
    for a, b, at in zip(begin, end, found):
        assert (at == -1) if a == b else (a <= at < b and shard.impacts[at] == shard.impacts[a:b].max())


# Divergence audit.

def plain_audit(rows):
    """All terms of all groups, priced one by one."""
    held, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for doc, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())
        counts[lang, source].update(words)
        for w in words:
            held[lang, w].add(doc)
    kept = defaultdict(list)
    for (lang, w), ids in held.items():
        if len(ids) >= 3:
            kept[lang].append(w)
    found = []
    for lang, source in groups:
        terms, others = kept[lang], sorted(s for g, s in groups if g == lang and s != source)
        whole = Counter()
        for g, s in groups:
            if g == lang:
                whole.update({w: counts[g, s][w] for w in terms})

        def shares(count):
            total = sum(count[w] for w in terms) + len(terms)
            return {w: 1 + 10 ** 9 * (count[w] + 1) // total for w in terms}

        p = shares(counts[lang, source])
        pairs = []
        for other in others:
            q = shares(counts[lang, other])
            pairs.append((-sum((p[w] - q[w]) ** 2 // q[w] for w in terms), other.encode()))
        q = shares(whole)
        over = [(-((p[w] - q[w]) ** 2 // q[w]), w) for w in terms if counts[lang, source][w] and p[w] > q[w]]
        for part, values, top in (("pair", pairs, None), ("term", over, 200)):
            found += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(sorted(values)[:top], 1)]
    return sorted(found)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    letters = str.maketrans("0123456789", "abcdefghij")
    return [(i, t.translate(letters), ("en", "de")[i % 5 == 0], f"s{int(rng.integers(0, 7)) ** 2 % 11}")
            for i, t in enumerate(texts(seed, n, 400))]


@pytest.mark.parametrize("block, chunk, held", [(4096, 64, 3_000_000), (5, 2, 300), (1, 1, 50)])
def test_audit_prices_every_term_of_every_pair(spark, monkeypatch, block, chunk, held):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("HELD_WORDS", held)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(3, 250)
    rows += [(900, None, "en", None), (901, "", None, "s1"), (902, "wa " * 30_000, "en", "hot"), (3, rows[3][1], "en", "again"),
             (3, "repeated id", "en", "s1"), (3, "repeated id", "en", "s1"), (4, "repeated", "en", "s1"), (None, "repeated", "en", "s2"),
             (None, "unnamed", "en", "s2"), (None, "unnamed", "en", "s2"), (904, "Ünïcode ünïcode", "xx", "a"),
             (905, "Ünïcode", "xx", "b"), (906, "nothing", "yy", "a"), (907, "here", "yy", "b"), (908, "alone alone", "zz", "a")]
    got = divergence.divergence(spark.createDataFrame(rows, DOCS).withColumns({"term": F.lit(1), "n": F.lit(2), "chunk": F.lit(3)}))
    assert sorted(map(tuple, got.collect())) == plain_audit(rows)


def test_audit_of_no_documents(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []


def test_equal_node_pairs_are_priced_once_and_exactly():
    counts = np.zeros((3, 1024), np.int64)
    counts[0, 3], counts[1, 700], counts[2, 700] = 10 ** 12, 10 ** 12, 5
    counts[:, 1000:] = -1
    sums = [int(c[c > 0].sum()) + 1000 for c in counts]
    there, back = divergence.pair_prices(counts, sums, np.array([0, 1]), np.array([1, 2]))

    def price(a, b):
        p, q = ([1 + 10 ** 9 * (int(c) + 1) // s for c in counts[k][:1000]] for k, s in ((a, sums[a]), (b, sums[b])))
        return sum((x - y) ** 2 // y for x, y in zip(p, q))

    assert there.tolist() == [price(0, 1), price(1, 2)] and back.tolist() == [price(1, 0), price(2, 1)]


# Nearest neighbours.

VECTORS = "vec_id long, embedding array<float>"


def plain_neighbours(rows, every, k):
    usable = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
    found = {}
    for at, (query, q) in enumerate(usable):
        if query is None or query % every:
            continue
        near = sorted((math.sqrt(float(((q - v) ** 2).sum())), i is None, i or 0) for other, (i, v) in enumerate(usable)
                      if other != at and len(v) == len(q))
        found.setdefault(query, []).append([(score, None if none else i) for score, none, i in near[:k]])
    return found


def test_few_vectors_give_exact_neighbours_and_unusable_ones_take_no_part(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200, rows[7][1]), (201, rows[7][1]), (100, rows[100][1]), (None, rows[7][1]), (300, None), (301, []), (302, [0.0] * 8),
             (303, [1.0] * 7 + [None]), (304, [1.0] * 7 + [float("nan")]), (400, [1.0] * 7 + [float("inf")]), (500, [1.0, 2.0]),
             (501, [1.0, 2.5]), (600, [2.0 ** 127] * 8), (601, [-2.0 ** 127] * 8)]
    table = spark.createDataFrame(rows, VECTORS).withColumns({"row": F.lit(1), "part": F.lit("x"), "label": F.lit(2)})
    got = defaultdict(list)
    for r in neighbours.nearest(table, 100, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    want = plain_neighbours(rows, 100, 10)
    assert set(got) == set(want) == {0, 100, 200, 500, 600}
    for query, lists in want.items():
        expected = sorted((rank, *entry) for entries in lists for rank, entry in enumerate(entries, 1))
        assert [g[0] for g in got[query]] == [e[0] for e in expected]
        np.testing.assert_allclose([g[1] for g in got[query]], [e[1] for e in expected], rtol=1e-12)
        if query != 100:  # two rows answer to 100
            assert [g[2] for g in got[query]] == [e[2] for e in expected]
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).collect() == []


def recall(got, rows, every, k):
    want = plain_neighbours(rows, every, k)
    found = defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
    hits = [len({i for _, i in lists[0]} & found[query]) / len(lists[0]) for query, lists in want.items()]
    return sum(hits) / len(hits)


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_over_learned_partitions(spark, monkeypatch, clusters):
    """Isotropic vectors, the hardest case, and clustered ones with a third of all rows equal; chunks of few rows."""
    monkeypatch.setattr(neighbours, "PART", 64)
    monkeypatch.setattr(neighbours, "CHUNK_BYTES", 8 * 32 * 100)
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 8 * 32 * 10)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(3000, 32))
    if clusters:
        points = 3 * rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 3000)] + 0.5 * points
        points[rng.random(3000) < 0.33] = points[17]
    rows = [(i, v) for i, v in enumerate(points.astype(np.float32).tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS), 20, 10).collect()
    assert len(got) == 150 * 10 and {r.rank for r in got} == set(range(1, 11))
    if not clusters:
        assert recall(got, rows, 20, 10) >= 0.9
    by_id = dict(rows)
    for r in got:
        exact = math.sqrt(sum((a - b) ** 2 for a, b in zip(by_id[r.query_id], by_id[r.vec_id])))
        assert r.vec_id != r.query_id and r.score == pytest.approx(exact, abs=1e-12)
    if clusters:  # ties among equal rows go to the smaller id, so ids must be those of brute force
        assert recall(got, rows, 20, 10) >= 0.9
        equal = [i for i, v in rows if v == by_id[17]]
        for query in (q for q in equal if q % 20 == 0):
            assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == query] == [i for i in equal if i != query][:10]


def test_recall_over_the_embeddings_of_the_sample(spark):
    for sf in ("sf0.001", "sf0.1"):
        table = f"/root/testdata/{sf}"
        rows = [tuple(r) for r in spark.read.parquet(f"{table}/embeddings.parquet").select("vec_id", "embedding").collect()]
        assert recall(neighbours.op13_learned_partitions(spark, table).collect(), rows, 100, 10) >= 0.9


def test_graph_parts_are_balanced(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(1024, 16))
    links = neighbours.neighbour_graph(spark, points)
    distance = ((points[:, None] - points) ** 2).sum(2)
    np.fill_diagonal(distance, np.inf)
    assert (np.sort(links, 1) == np.sort(np.argsort(distance, 1)[:, :neighbours.LINKS], 1)).mean() > 0.999
    part = neighbours.balanced_parts(points, links, 8)
    assert np.bincount(part).max() <= math.ceil(1024 / 8 * neighbours.SLACK)
    assert (part[links] == part[:, None]).mean() > 0.3  # 1 in 8 by chance
