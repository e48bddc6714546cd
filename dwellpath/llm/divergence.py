"""Source divergence audit over hash-consed segment trees of term counts.

Per language, the terms that occur in at least ``MIN_DOCS`` of its documents are kept, and
every group (language, source) counts them.  A group's counts are the leaves of a segment
tree over term ids.  Trees are hash-consed: equal subtrees, of whichever group, are one
node, so the many stretches in which a source lacks all terms are stored once.  Two groups
are compared by walking both trees at once from their roots; equal pairs of nodes met
along the way are merged and carry their multiplicity, so each is expanded, and at the
leaves priced, once.

Term ids are dealt in blocks of about ``BLOCK`` terms of similar frequency, whose subtrees
are compared independently; a price is a sum over leaves, so Spark adds up the blocks.
Sources meet in chunks of ``CHUNK``, so a task holds at most ``BLOCK`` x 2 ``CHUNK`` counts.

Words are counted within tasks before anything is shuffled, so a frequent word or a hot
source arrives as one row per task and not per occurrence.

Null text, language or source count as empty.  A document is an id: rows that repeat an id
add to the counts, but to the number of documents of a term only once (a null id is one
id).  A group without kept terms takes part with value 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwellpath.llm.common import pieces_of, table, text_bytes
from dwellpath.session import cut_lineage

# A term must occur in so many documents of its language, shares are scaled to
# this whole, and so many terms are listed per group.
MIN_DOCS = 3
WHOLE = 1_000_000_000
TOP_TERMS = 200

BLOCK = 4096
CHUNK = 64

# Terms are runs of letters A-Z, in lower case, and of everything beyond ASCII; the rest becomes blanks.
LETTERS = bytes(code if code >= 128 else ord(chr(code).lower()) if chr(code).isalpha() else 32 for code in range(256))

# Words held in a task before their counts are handed on.
HELD_WORDS = 3_000_000

_COUNTED = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())),
                      ("counts", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
_BIGGEST_EXACT = (2 ** 63 - 1) // WHOLE - 1


def divergence(docs: DataFrame) -> DataFrame:
    """Distances between the sources of a language, and the terms each source overuses.

    Needs ``doc_id``, ``text``, ``lang`` and ``source``; other columns are ignored.  Returns
    ``lang, source, part, item, value, rank``.  With p = 1 + floor(10^9 (count + 1) / (N + V))
    for the group and q likewise for the other side, a term's price is
    floor((p - q)^2 / q).  Part ``pair``: the sum of prices against each other source of the
    language.  Part ``term``: the price against the whole language of each term that the
    group has and whose p exceeds q, the ``TOP_TERMS`` highest.
    """
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    # three readers need the counts, and counting reads the texts, so it is done once
    counted = cut_lineage(named.mapInArrow(
        count_terms, "lang string, term string, sources array<string>, counts array<long>, docs array<long>"))
    counts = cut_lineage(
        counted.join(kept_terms(counted), ["lang", "term"], "left_semi")
        .select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("entry"))
        .groupBy("lang", "term", F.col("entry.sources").alias("source")).agg(F.sum("entry.counts").alias("n")))
    groups = _groups(named, counts)
    blocks = _in_blocks(counts)
    priced = cut_lineage(_with_groups(blocks, groups).groupBy("lang", "level", "part", "one", "two").applyInPandas(
        compare_block, "lang string, source string, part string, item string, value long"))
    return _ranked(priced, groups)


class Numbers(dict):
    """Numbers things from 0 on in the order they are first asked for."""

    def __missing__(self, thing) -> int:
        self[thing] = number = len(self)
        return number


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and their number in each text."""
    letters = np.frombuffer(b" ".join([*(text.translate(LETTERS) for text in texts), b""]), np.uint8)
    inside = letters != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside])])
    limits = np.searchsorted(starts, np.cumsum([0, *(len(text) + 1 for text in texts)]))
    return words, np.diff(limits)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language and term: its counts by source, and up to ``MIN_DOCS`` different ids of documents that hold it.

    So many ids are enough to tell whether as many exist anywhere.  Words are numbered as
    they are read, and counted by sorting numbers.
    """
    terms, langs, sources, docs = Numbers(), Numbers(), Numbers(), Numbers()
    words: list[np.ndarray] = []
    sizes: list[int] = []
    owners: list[tuple[int, int, int]] = []
    held = 0

    def result() -> pa.RecordBatch:
        numbers = (terms, langs, sources, docs)
        by_doc = np.repeat(np.array(owners, np.int64), sizes, axis=0)
        key = np.concatenate(words)
        for column, known in zip(by_doc.T, numbers[1:]):
            key = key * len(known) + column
        key, times = np.unique(key, return_counts=True)
        group, doc = key // len(docs), key % len(docs)
        place = group // len(sources)
        at_group, at_place = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (group, place))
        # a document that repeats its id in another source counts once
        pairs = np.sort(place * len(docs) + doc)
        holder, offsets = _first_of_each(pairs[np.diff(pairs, prepend=-1) > 0], len(docs))
        names = pa.array(list(docs), pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array(list(langs), pa.string()).take(pa.array(place[at_place] % len(langs))),
            pa.array(list(terms), pa.binary()).cast(pa.string()).take(pa.array(place[at_place] // len(langs))),
            *(pa.ListArray.from_arrays(np.append(np.searchsorted(at_group, at_place), len(at_group)).astype(np.int32), values)
              for values in (pa.array(list(sources), pa.string()).take(pa.array(group[at_group] % len(sources))),
                             pa.array(np.add.reduceat(times, at_group)))),
            pa.ListArray.from_arrays(offsets, names.take(pa.array(holder)))], schema=_COUNTED)

    for piece in pieces_of(batches):
        found, per_text = words_of(text_bytes(piece.column("text")))
        found = found.dictionary_encode()
        numbers = np.fromiter(map(terms.__getitem__, found.dictionary.to_pylist()), np.int64, len(found.dictionary))
        words.append(numbers[found.indices.to_numpy()])
        sizes.extend(per_text.tolist())
        owners.extend(zip(*(map(numbers.__getitem__, piece.column(name).to_pylist())
                            for name, numbers in (("lang", langs), ("source", sources), ("doc_id", docs)))))
        held += len(found)
        if held > HELD_WORDS:
            yield result()
            for known in (terms, langs, sources, docs, words, sizes, owners):
                known.clear()
            held = 0
    if held:
        yield result()


def _first_of_each(pairs: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``MIN_DOCS`` second parts of sorted ``first * wide + second``, and where each first part's begin."""
    first = pairs // wide
    starts = np.flatnonzero(np.diff(first, prepend=-1))
    sizes = np.diff(np.append(starts, len(first)))
    kept = np.arange(len(first)) - np.repeat(starts, sizes) < MIN_DOCS
    return pairs[kept] % wide, np.concatenate([[0], np.cumsum(np.minimum(sizes, MIN_DOCS))]).astype(np.int32)


def kept_terms(counted: DataFrame) -> DataFrame:
    """(lang, term) of the terms that occur in at least ``MIN_DOCS`` documents."""
    seen = counted.groupBy("lang", "term").agg(F.max(F.size("docs")).alias("most"), F.sum(F.size("docs")).alias("all"))
    # too few ids even if all differ, or enough in one place: no id needs to be compared
    able = cut_lineage(seen.where(F.col("all") >= MIN_DOCS).select("lang", "term", (F.col("most") >= MIN_DOCS).alias("sure")))
    compared = (
        counted.join(able.where("not sure"), ["lang", "term"], "left_semi")
        .select("lang", "term", F.explode("docs").alias("doc")).distinct()
        .groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS).select("lang", "term"))
    return able.where("sure").select("lang", "term").union(compared)


def _groups(named: DataFrame, counts: DataFrame) -> DataFrame:
    """Every (lang, source) with its ``chunk``, the language's number of chunks and terms, and the sum of its counts."""
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    order = Window.partitionBy("lang").orderBy("source")
    occurring = named.select("lang", "source").distinct()
    placed = occurring.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / CHUNK).cast("int"))
    return cut_lineage(
        placed.join(sums, ["lang", "source"], "left").join(terms, "lang", "left").select(
            "lang", "source", "chunk", F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("terms", F.lit(0)).alias("terms"),
            (F.max("chunk").over(Window.partitionBy("lang")) + 1).alias("chunks")))


def _in_blocks(counts: DataFrame) -> DataFrame:
    """Counts with the block (``level``, ``part``) and the ``leaf`` of their term.

    A level holds terms of similar frequency, and is dealt by hash into parts of about
    ``BLOCK`` terms, so terms are numbered within bounded parts only.
    """
    totals = counts.groupBy("lang", "term").agg(F.sum("n").alias("whole")).withColumn(
        "level", F.floor(F.log2("whole")).cast("int"))
    # some 60 rows per language; written, so that the join below knows their size
    parts = cut_lineage(totals.groupBy("lang", "level").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")))
    dealt = totals.join(parts, ["lang", "level"]).withColumn(
        "part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
    block = Window.partitionBy("lang", "level", "part")
    leaves = dealt.select(
        "lang", "term", "whole", "level", "part",
        (F.row_number().over(block.orderBy(F.desc("whole"), "term")) - 1).cast("int").alias("leaf"),
        F.count(F.lit(1)).over(block).cast("int").alias("leaves"))
    return cut_lineage(counts.join(leaves, ["lang", "term"]))


def _with_groups(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of each block for each pair of chunks (``one`` <= ``two``).

    A row without a term describes a source that takes part, whether or not the block has
    any term of it: the sum of its counts and the numbers of terms in block and language.
    """
    kinds = ["lang", "level", "part", "leaves"]
    heads = blocks.select(*kinds).distinct().join(groups, "lang").select(
        *kinds, "source", "chunk", "chunks", "terms", F.lit(None).cast("string").alias("term"), F.lit(0).alias("leaf"),
        F.col("total").alias("n"), F.lit(0).cast("long").alias("whole"))
    rows = blocks.join(groups.select("lang", "source", "chunk", "chunks", "terms"), ["lang", "source"]).select(heads.columns)
    wholes = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    return (
        heads.unionByName(rows).join(wholes, "lang")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("*", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two")))


def compare_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Prices of one block between the sources of one pair of chunks, and its terms of highest price."""
    is_head = rows["term"].isna()
    heads, entries = rows[is_head].sort_values("source"), rows[~is_head]
    lang, size, terms = heads["lang"].iloc[0], int(heads["leaves"].iloc[0]), int(heads["terms"].iloc[0])
    sources = heads["source"].tolist()
    place = {source: at for at, source in enumerate(sources)}
    counts = np.full((len(sources), 1 << max(0, size - 1).bit_length()), -1, np.int64)  # -1: beyond the last term
    counts[:, :size] = 0
    counts[entries["source"].map(place).to_numpy(), entries["leaf"].to_numpy()] = entries["n"].to_numpy()
    sums = [int(total) + terms for total in heads["n"]]
    within = heads["one"].iloc[0] == heads["two"].iloc[0]
    chunk = heads["chunk"].to_numpy()
    left, right = np.nonzero(np.triu(np.ones((len(sources), len(sources)), bool), 1))
    if not within:
        apart = chunk[left] != chunk[right]
        left, right = left[apart], right[apart]
    there, back = pair_prices(counts, sums, left, right)
    found = [(lang, sources[a], "pair", sources[b], value) for a, b, value in zip(left, right, there)]
    found += [(lang, sources[b], "pair", sources[a], value) for a, b, value in zip(left, right, back)]
    if within:
        whole = int(heads["lang_total"].iloc[0]) + terms
        for source, group in entries.groupby("source"):
            found += [(lang, source, "term", term, value)
                      for term, value in _overused(group, sums[place[source]], whole)]
    return pd.DataFrame(found, columns=["lang", "source", "part", "item", "value"])


def pair_prices(counts: np.ndarray, sums: list[int], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prices of ``left`` against ``right`` rows of ``counts``, and the other way round.

    ``counts`` has a power of two of columns; -1 marks a leaf without a term.
    """
    values, nodes = np.unique(counts, return_inverse=True)
    nodes = nodes.reshape(counts.shape)
    children = []
    while nodes.shape[1] > 1:
        known = int(nodes.max()) + 1
        made, inverse = np.unique(nodes[:, 0::2] * known + nodes[:, 1::2], return_inverse=True)
        children.append((made // known, made % known))
        nodes = inverse.reshape(len(nodes), -1)
    roots = nodes[:, 0]
    pair, a, b, times = np.arange(len(left)), roots[left], roots[right], np.ones(len(left), np.int64)
    for low, high in reversed(children):
        pair, a, b, times = _merged(np.concatenate([pair, pair]), np.concatenate([low[a], high[a]]),
                                    np.concatenate([low[b], high[b]]), np.concatenate([times, times]))
    real = values[a] >= 0
    pair, a, b, times = pair[real], values[a[real]], values[b[real]], times[real]
    whole = np.array(sums, object if max(sums, default=0) > _BIGGEST_EXACT else np.int64)
    p, q = share(a, whole[left[pair]]), share(b, whole[right[pair]])
    squares = (p - q) * (p - q)
    there, back = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    np.add.at(there, pair, squares // q * times)
    np.add.at(back, pair, squares // p * times)
    return there, back


def _merged(pair: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal pairs of nodes become one, with the sum of their multiplicities."""
    if not len(pair):
        return pair, a, b, times
    wide_a, wide_b = int(a.max()) + 1, int(b.max()) + 1
    key, inverse = np.unique((pair * wide_a + a) * wide_b + b, return_inverse=True)
    summed = np.zeros(len(key), np.int64)
    np.add.at(summed, inverse, times)
    return key // wide_b // wide_a, key // wide_b % wide_a, key % wide_b, summed


def share(counts: np.ndarray, whole) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / whole), exactly, as 64-bit integers."""
    if len(counts) and int(counts.max()) >= _BIGGEST_EXACT:
        counts = counts.astype(object)
    return np.asarray(1 + WHOLE * (counts + 1) // whole).astype(np.int64)


def _overused(group: pd.DataFrame, total: int, whole: int) -> list[tuple[str, int]]:
    """The terms of highest price of one source against the language; equal pairs of counts are priced once."""
    counts = np.column_stack([group["n"].to_numpy(), group["whole"].to_numpy()])
    kinds, which = np.unique(counts, axis=0, return_inverse=True)
    p, q = share(kinds[:, 0], total), share(kinds[:, 1], whole)
    price = np.where(p > q, (p - q) * (p - q) // q, -1)[which.reshape(-1)]
    able = np.flatnonzero(price >= 0)
    if len(able) > TOP_TERMS:
        able = able[price[able] >= np.partition(price[able], -TOP_TERMS)[-TOP_TERMS]]
    terms = group["term"].to_numpy()
    best = sorted(((-int(price[at]), terms[at].encode()) for at in able))[:TOP_TERMS]
    return [(term.decode(), -value) for value, term in best]


def _ranked(priced: DataFrame, groups: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    others = groups.select("lang", F.col("source").alias("item"))
    # languages without kept terms have no block, and their sources still differ by 0
    bare = groups.where("terms = 0").select("lang", "source").join(others, "lang").where("source <> item").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    listed = priced.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(bare).withColumn("rank", F.row_number().over(order)).unionByName(listed).select(
        "lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the whole ``documents`` table."""
    return divergence(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


OP12_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
w as (select doc_id, lang, source, unnest(terms) as term from d),
kept as (select lang, term from w group by lang, term
         having count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) >= 3),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
v as (select lang, count(*) as v from kept group by lang),
g as (select distinct lang, source from d),
gn as (select g.lang, g.source, coalesce(sum(c.n), 0) as total
       from g left join c on c.lang = g.lang and c.source = g.source group by all),
ln as (select lang, sum(total) as total from gn group by lang),
grid as (
  select gn.lang, gn.source, kept.term, coalesce(c.n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)::hugeint) // (gn.total + v.v)::hugeint as p
  from gn join kept on kept.lang = gn.lang join v on v.lang = gn.lang
  left join c on c.lang = gn.lang and c.source = gn.source and c.term = kept.term),
pairs as (
  select a.lang, a.source, b.source as item,
         coalesce((select sum((x.p - y.p) * (x.p - y.p) // y.p) from grid x join grid y
                   on x.lang = y.lang and x.term = y.term
                   where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source),
whole as (
  select c.lang, c.term, 1 + (1000000000::hugeint * (sum(c.n) + 1)::hugeint) // (any_value(ln.total) + any_value(v.v))::hugeint as q
  from c join ln on ln.lang = c.lang join v on v.lang = c.lang group by c.lang, c.term),
terms as (
  select grid.lang, grid.source, grid.term as item, ((p - q) * (p - q) // q)::bigint as value
  from grid join whole on whole.lang = grid.lang and whole.term = grid.term where n > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value,
         (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
  union all
  select lang, source, 'term', item, value,
         (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200
"""
