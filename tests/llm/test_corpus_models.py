"""Near duplicates, scores, toxicity and the pipeline against plain Python and held-out rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from dwellpath.llm import minhash, mixing, toxicity
from dwellpath.llm.components import components
from dwellpath.llm.queries import QUERIES
from tests.llm.data import LONG, no_documents, odd_documents

SF_DIR = "/root/testdata/sf0.001"


def fold(doc, n):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % n


# Near duplicates


def plain_groups(rows, size, percent=80):
    sets = [minhash.shingles_of((text or "").encode().lower().split(), size) for _, text in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[top(a)] = top(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(k)] = min(least.get(top(k), doc), doc)
    return sorted(((doc, len(sets[k]), None if doc is None else least[top(k)]) for k, (doc, _) in enumerate(rows)), key=repr)


def groups(frame):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()], key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_brute_force(spark, size):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    base = [draw.choices(words, k=draw.randint(3, 80)) for _ in range(6)]
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect() if r.doc_id != 10]
    for k in range(80):
        copy = list(base[k % 6])
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        rows.append((100 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, size)
    assert groups(got) == plain_groups(rows, size)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect())


def test_crowded_region_is_one_group(spark):
    draw = random.Random(8)
    base = [f"w{draw.randrange(500)}" for _ in range(200)]
    rows = []
    for k in range(300):
        copy = list(base)
        copy[draw.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_template_joins_variants_that_are_unlike_each_other(spark):
    draw = random.Random(12)
    base = [f"w{k}" for k in range(200)]
    rows = [(5000, " ".join(base))]
    for k in range(1000):
        copy = list(base)
        for at in draw.sample(range(1, 199, 2), 9):
            copy[at] = f"x{k}_{at}"
        rows.append((k, " ".join(copy)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert groups(got) == plain_groups(rows, 2)
    assert {r.component_id for r in got.collect()} == {0}


def test_crowded_unlike_variants_without_template_equal_brute_force(spark):
    draw = random.Random(13)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(300):
        copy = list(base)
        for at in draw.sample(range(1, 199, 2), draw.choice([2, 6, 8, 10, 12])):
            copy[at] = f"x{k}_{at}"
        rows.append((k, " ".join(copy)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert groups(got) == plain_groups(rows, 2)


def test_groups_of_sample_documents_equal_all_pairs(spark):
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    sets = {i: minhash.shingles_of((t or "").encode().lower().split(), 2) for i, t in texts.items()}
    holders = {}
    for i, own in sets.items():
        for shingle in own:
            holders.setdefault(shingle, []).append(i)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets.items():
        common = Counter(j for shingle in own for j in holders[shingle] if j < i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    got = QUERIES["op1_minhash_forest"](spark, path).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in sets}
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(own) for i, own in sets.items()}


def test_each_pair_is_compared_at_the_first_shingle_it_shares(spark):
    draw = np.random.default_rng(14)
    pool = draw.integers(1, 1 << 63, 400, np.uint64)
    sets = [np.sort(draw.choice(pool, 300, replace=False)) for _ in range(12)]
    frame = spark.createDataFrame([(k, bytearray(own.tobytes()), bytearray(minhash._signatures([own])[0].tobytes()))
                                   for k, own in enumerate(sets)], "rep long, shingles binary, signature binary")
    firsts = {}
    for r in minhash._first_shingles(frame, 80).collect():
        firsts.setdefault(r.rep, {})[r.shingle] = r
    assert max(r.place for rows in firsts.values() for r in rows.values()) < minhash.BEFORE
    for rows in firsts.values():
        ordered = sorted(rows.values(), key=lambda r: r.place)
        assert all(r.before == [q.shingle for q in ordered[:r.place]] for r in ordered)
    met = 0
    for a in firsts:
        for b in range(a):
            common = firsts[a].keys() & firsts[b].keys()
            if common:
                met += len(common) > 1
                assert sum(not set(firsts[a][s].before) & set(firsts[b][s].before) for s in common) == 1
    assert met > 10


def test_components_of_links_of_many_tasks(spark, monkeypatch):
    import sys
    monkeypatch.setattr(sys.modules["dwellpath.llm.components"], "TASK_LINKS", 60)
    draw = random.Random(2)
    pairs = [(k, k + 1) for k in range(400)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000)]
    draw.shuffle(pairs)
    got = {(r.node, r.root) for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(16)).collect()}
    assert got == {(k, 0) for k in range(1, 401)} | {(k, 1000) for k in range(1001, 1200)}


def test_masks_never_bound_an_overlap_from_below(spark):
    draw = np.random.default_rng(4)
    pool = draw.integers(1, 1 << 63, 900, np.uint64)
    sets = [np.unique(draw.choice(pool, n)) for n in (1, 5, 60, 300, 800)]
    columns = [*minhash.MASK, "size"]
    rows = [[k, *mask, len(own)] for k, (mask, own) in enumerate(zip(minhash._masks(sets).tolist(), sets))]
    frame = spark.createDataFrame(rows, ["rep", *columns])
    bounds = frame.alias("x").join(frame.alias("y"), minhash.F.lit(True)).select(
        minhash.F.col("x.rep").alias("a"), minhash.F.col("y.rep").alias("b"), minhash._overlap_at_most().alias("most"))
    for r in bounds.collect():
        shared = len(np.intersect1d(sets[r.a], sets[r.b]))
        assert r.most >= shared and (r.a != r.b or r.most == shared)


def test_texts_of_a_repeated_id_are_judged_one_by_one(spark):
    rows = [(2, LONG + " fourteen"), (5, LONG + " fourteen"), (5, "quite another text of its own"), (5, "quite another text of its own"),
            (5, None), (7, "solo")]
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [
        (2, LONG + " fourteen"), (5, ""), (5, "quite another text of its own"), (7, "solo")]


def test_one_row_of_each_group_stays(spark):
    docs = odd_documents(spark)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert [i for i in ids if i < 10] == [1, 4, 5, 6, 7, 9]
    assert kept.where("doc_id is null").count() == 2
    assert minhash.drop_near_duplicates(no_documents(spark)).count() == 0


def test_components(spark):
    draw = random.Random(1)
    pairs = [(k, k + 1) for k in range(400)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000)]
    draw.shuffle(pairs)
    got = {(r.node, r.root) for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == {(k, 0) for k in range(1, 401)} | {(k, 1000) for k in range(1001, 1200)}


# Scores


def test_base_scores_equal_brute_force(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in docs.collect()]
    counts = Counter(w for doc, words in rows if fold(doc, 7) != 2 for w in words)
    total, types = sum(counts.values()), len(counts)
    want = sorted((str(doc), fold(doc, 7) == 2, len(words), sum(counts[w] > 0 for w in words), total,
                   round(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words), 6)) for doc, words in rows)
    got = mixing.score_texts(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and np.isfinite(r.score) and r.bits_per_byte > 0 for r in got)
    assert mixing.score_texts(no_documents(spark)).count() == 0


def test_held_out_texts_score_better_than_by_word_counts(spark):
    rows = QUERIES["op2_context_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    held = rows[rows.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_spelling_is_a_distribution():
    # over all words of one or two of four letters and the rest, probabilities stay below one
    histories = np.zeros((mixing.CONTEXTS, 1 << mixing.TABLE_BITS, 2), np.int32)
    model = mixing.Spelling(mixing._stretched(histories), np.full((mixing.GATES, mixing.CONTEXTS + 1), 0.3), np.full((8, mixing.MAP_STEPS), 0.5))
    letters = [bytes([b]) for b in range(256) if bytes([b]) not in b" \t\n\r\x0b\x0c"]
    total = sum(2 ** mixing._spelling_cost(letters, model))
    assert 0 < total < 1


def test_passages_have_about_a_dozen_words():
    draw = np.random.default_rng(4)
    symbols = [mixing._END, *(f"w{k}".encode() for k in range(5000))]
    codes = np.append(draw.integers(1, 5001, 60_000), 0)
    _, lengths = mixing._passages(codes, symbols)
    assert lengths.sum() == len(codes) and 11 < lengths.mean() < 13


def test_order_of_known_words_moves_the_score(spark):
    # texts repeat a phrase's order in training; held out, the same words in other orders must score worse
    draw = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    ids = [k for k in range(2000) if fold(k, 7) != 2][:400]
    held = [k for k in range(2000, 3000) if fold(k, 7) == 2][:6]

    def text(turn):
        return [words[(turn + k) % 40] for k in range(30)]

    rows = [(i, " ".join(text(draw.randrange(40)) + [f"x{draw.randrange(10**6)}"])) for i in ids]
    shuffled = [draw.sample(text(k), 30) for k in range(5)]
    rows += list(zip(held, [" ".join(["y", *text(3)[1:]]), *(" ".join(["y", *some[1:]]) for some in shuffled)]))
    got = {r.doc_id: r for r in mixing.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    in_order, *others = (got[i].score / got[i].n_tokens for i in held)
    assert all(in_order > other + 0.5 for other in others)


def test_bits_and_histories_follow_the_running_text(spark):
    texts = ["to be or not to be", "be not", "", "to"]
    docs = spark.createDataFrame([(i, t) for i, t in zip([k for k in range(50) if fold(k, 7) != 2], texts)], "doc_id long, text string")
    blocks = mixing._blocks(docs, 7, 2)
    flat = b"".join(t.encode() + b" \n" if t else b"\n" for t in texts)
    letters = sum(np.array(r.letters) for r in blocks.select("letters").collect())
    assert letters.tolist() == np.bincount(np.frombuffer(flat, np.uint8), minlength=256).tolist()
    code = mixing.Code.frequent(letters)
    assert sum(2.0 ** -int(n) for n in code.length) == 1
    histories = mixing._count_histories(blocks.select("words", "held_out", "sizes", "codes"), code)
    assert (histories.sum(axis=(1, 2)) == sum(int(code.length[b]) for b in flat)).all()
    # a first letter is told apart by the word before: "be" after "to" and "be" after "or" or an end have other slots
    symbols = [mixing._END, b"to", b"be", b"or"]
    first = [mixing._bits_of(mixing._Spelled(symbols), np.array([2]), np.array([k]), code).slots[5][0] for k in (0, 1, 3)]
    assert len(set(first)) == 3


# Toxicity


def test_held_out_toxicity(spark):
    rows = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.95
    assert held[held.toxic == 0].predicted.mean() < 0.02
    assert held[held.toxic == 1].predicted.mean() > 0.75
    assert rows.score.between(0, 1).all() and len(rows) == 10_000


def test_odd_texts_and_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    scored, column = toxicity.score(docs, toxicity.train(docs, labels))
    assert column == "score_" and scored.count() == docs.count()
    assert toxicity.drop_toxic(docs, labels.where("false")).count() == docs.count()
    assert toxicity.drop_toxic(no_documents(spark), labels).count() == 0


def test_few_toxic_documents_are_learned_from(spark):
    rows = [(k, f"plain words number n{k} about weather and gardens") for k in range(200)]
    toxic = [k for k in range(200, 230) if fold(k, 5) != 0][:3]
    rows += [(k, "vilest slander against everyone") for k in toxic]
    docs = spark.createDataFrame([*rows, (1000, "vilest slander against everyone")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 200)) for k, _ in rows], "doc_id long, toxic int")
    scored, column = toxicity.score(docs, toxicity.train(docs, labels))
    scores = {r.doc_id: r[column] for r in scored.collect()}
    assert scores[1000] >= 0.5 and all(scores[k] < 0.5 for k in range(200))


def test_all_clear_features_are_kept(spark):
    counts = spark.range(6000).selectExpr("id as bucket", "10L as positive", "20L as total")
    assert len(toxicity._kept_features(counts, 10, 1000)) == 6000


def test_risk_recovers_the_clean_class():
    draw = random.Random(2)
    toxic = [np.array([draw.randrange(5)]) for _ in range(300)]
    clean = [np.array([5 + draw.randrange(20)]) for _ in range(900)]
    weights, bias = toxicity.fit_nnpu(toxic[:150], toxic[150:] + clean, 25, 150 / 1050)
    assert (weights[:5] + bias > 0).all() and (weights[5:] + bias < 0).all()


# Pipeline


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
    left = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert 0.5 * documents.count() < len(left) <= documents.count() and left.doc_id.is_unique


def test_pipeline_takes_odd_rows(spark, tmp_path):
    wide = odd_documents(spark)
    docs = wide.selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "cast(0 as long) as n_chars",
                           "n_words as hits")
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, LONG)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert 1 not in left and 9 in left and 10 in left
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_blocks_are_written_and_scored_one_by_one(spark, monkeypatch):
    """A task that makes many blocks holds one at a time, in the file too, and the blocks are dealt over as many tasks."""
    import glob

    import pyarrow.parquet as pq
    paths = []
    plain = mixing.shared_path
    monkeypatch.setattr(mixing, "shared_path", lambda *a: (paths.append(plain(*a)), paths[-1])[1])
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(mixing, "GROUP_BYTES", 1, raising=False)
    docs = spark.createDataFrame([(k, f"word{k % 7} of a text {k} " * 20) for k in range(60)], "doc_id long, text string").coalesce(1)
    scored = mixing.score_texts(docs)
    files = [pq.ParquetFile(name).metadata for name in glob.glob(f"{paths[0].removeprefix('file:')}/*.parquet")]
    blocks = sum(file.num_rows for file in files)
    assert blocks > 10 and sum(file.num_row_groups for file in files) == blocks
    assert scored.rdd.getNumPartitions() == blocks and scored.count() == 60
