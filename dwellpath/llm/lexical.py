"""Ranked lexical search by best-first document intervals over range-maximum tables.

Documents are read once for the terms that some item asks for; what is kept of a document
is its length and the places of those terms, so the texts themselves never move.  Within a
task, documents form shards of bounded size.  A shard numbers its documents from short to
long and has, for each term, the list of its documents with their impact (the score that
the term gives the document), and above all lists one sparse table that finds the largest
impact in any stretch of a list with two look-ups.

An item is searched by intervals of document numbers.  The sum over its terms of the largest
impact inside an interval bounds the score of every document there.  The intervals with
the highest bounds come first: the document with the largest impact is scored, and the
rest on either side becomes two intervals with bounds of their own.  Intervals of a few
documents are scored as a whole.  The search of a shard ends when no interval left can
reach the item's tenth best score so far, which a task carries on from shard to shard.

Items are searched in blocks of at most about ``BLOCK_TERMS`` terms, whatever their number;
only a block's terms go to the tasks.

Rows are documents and rows are items: a repeated ``doc_id`` or ``item_id`` is searched and
answered once per row.  Null and empty texts hold no term, are found by nothing and find
nothing.  A null ``doc_id`` comes after all others among equal scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwellpath.llm.common import documents, pieces_of, table, text_bytes
from dwellpath.session import cut_lineage

# Fixed value: maximal runs of digits, letters A-Z and everything beyond ASCII, as UTF-8 bytes.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

TOP = 10

# Terms of the items that are searched in one pass over the documents.
BLOCK_TERMS = 200_000
# A shard ends after so many documents or list entries.
SHARD_DOCS, SHARD_ENTRIES = 16_384, 1_000_000
# Intervals of so few documents are scored as a whole, more where an item has very many terms.
LEAF = 128
# Intervals taken from the front at a time, and list bounds held for an item.
STEP, FRONT = 32, 4_000_000

_NO_ID = np.iinfo(np.int64).max


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each item: ``item_id, rank, doc_id, score``.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and ``text``; other
    columns are ignored.  With N documents that hold a term, L terms in all, n in the
    document, df documents holding the term and tf occurrences in the document, a term
    weighs w = floor(1000 ln((2N + 2) / (2df + 1))), m = 10 + (90 n N) div L, and the score
    sums w ((10^9 tf) div (1000 tf + 8m)) over the item's different terms.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = cut_lineage(items.select(F.monotonically_increasing_id().alias("row"), "item_id", "text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // (8 * BLOCK_TERMS)) or 1  # terms have some 8 bytes with what separates them
    found = [_search_block(docs, asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block), top)
             for block in range(blocks)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """``row, doc_id, score``: each task's best documents for the items of one block."""
    spark = docs.sparkSession
    rows = asked.select("row", "text").collect()  # one block, bounded by BLOCK_TERMS
    vocabulary: dict[bytes, int] = {}
    queries = []
    for row in rows:
        terms = set(TERM.findall((row["text"] or "").encode().lower()))
        queries.append((row["row"], np.array(sorted(vocabulary.setdefault(t, len(vocabulary) + 1) for t in terms), np.int64)))
    known = spark.sparkContext.broadcast(vocabulary)
    lists = cut_lineage(docs.mapInArrow(
        lambda batches: term_places(batches, known.value), "doc_id long, n long, terms binary, times binary"))
    sizes = lists.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, n_terms = sizes[0], sizes[1] or 0
    counted = lists.select("terms").mapInArrow(
        lambda batches: holders(batches, len(vocabulary) + 1), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(vocabulary) + 1, np.int64)
    for row in counted.collect():  # one row per term of the block
        weights[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
    shared = spark.sparkContext.broadcast((weights, queries))
    return cut_lineage(lists.mapInArrow(
        lambda batches: search_shards(batches, *shared.value, n_docs, n_terms, top), "row long, doc_id long, score long"))


def term_places(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Per document with any term: its number of terms, and which known terms it holds how often."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("times", pa.binary())])
    number = vocabulary.get
    for piece in pieces_of(batches):
        lengths, kept, held = [], [], []
        for at, text in enumerate(text_bytes(piece.column("text"))):
            words = TERM.findall(text.lower())
            if words:
                kept.append(at)
                lengths.append(len(words))
                held.append(np.fromiter(filter(None, map(number, words)), np.int64))
        if not kept:
            continue
        owner = np.repeat(np.arange(len(kept)), [len(h) for h in held])
        wide = len(vocabulary) + 1
        keys, times = np.unique(owner * wide + np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(kept) + 1) * wide)
        terms, times = (keys % wide).astype(np.int32), times.astype(np.int32)
        spans = list(zip(cuts[:-1], cuts[1:]))
        yield pa.RecordBatch.from_arrays([
            piece.column("doc_id").take(pa.array(kept)), pa.array(lengths, pa.int64()),
            pa.array([terms[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([times[a:b].tobytes() for a, b in spans], pa.binary())], schema=schema)


def holders(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How many documents hold each term."""
    counts = np.zeros(size, np.int64)
    for batch in batches:
        counts += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=size)
    terms = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(counts[terms])], names=["term", "df"])


class Shard:
    """Lists of some documents: sorted keys (term, document), impacts, and the table of largest impacts."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, owner: np.ndarray, terms: np.ndarray, times: np.ndarray,
                 weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        order = np.lexsort((ids, lengths))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.size = ids[order], len(ids)
        slow = 10 + 90 * lengths * n_docs // n_terms
        impacts = weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * slow[owner]))
        useful = impacts > 0
        keys, impacts = (terms.astype(np.int64) * self.size + place[owner])[useful], impacts[useful]
        sort = np.argsort(keys)
        self.keys, self.impacts = keys[sort], impacts[sort]
        self.table = self._range_maxima()

    def _range_maxima(self) -> list[np.ndarray]:
        """``table[j][i]``: where the largest of the 2^j impacts from ``i`` on is."""
        levels = [np.arange(len(self.keys), dtype=np.int32)]
        longest = int(np.diff(np.flatnonzero(np.diff(self.keys // self.size, prepend=-1, append=-1))).max(initial=0))
        while 1 << len(levels) <= longest:
            half, before = 1 << (len(levels) - 1), levels[-1]
            one, two = before[:-half], before[half:]
            levels.append(np.where(self.impacts[one] >= self.impacts[two], one, two))
        return levels

    def largest(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the largest impact of each stretch ``[begin, end)`` is; -1 for empty ones."""
        length = (end - begin).ravel()
        result = np.full(length.shape, -1, np.int64)
        level = np.frexp(np.maximum(length, 1))[1] - 1
        first, last = begin.ravel(), end.ravel()
        for j in np.unique(level[length > 0]):
            here = np.flatnonzero((level == j) & (length > 0))
            one, two = self.table[j][first[here]], self.table[j][last[here] - (1 << j)]
            result[here] = np.where(self.impacts[one] >= self.impacts[two], one, two)
        return result.reshape(begin.shape)

    def search(self, terms: np.ndarray, best: "Best") -> None:
        """Offer ``best`` every document of the shard that can be among the best for ``terms``."""
        begin, end = np.searchsorted(self.keys, terms * self.size), np.searchsorted(self.keys, (terms + 1) * self.size)
        present = end > begin
        terms, begin, end = terms[present], begin[present], end[present]
        if not len(terms):
            return
        leaf = max(LEAF, self.size * len(terms) // FRONT)
        step = max(1, min(STEP, FRONT // len(terms)))
        low, high = np.array([0]), np.array([self.size])
        begin, end = begin[:, None], end[:, None]
        bound, split = self._bounds(begin, end)
        while True:
            able = np.flatnonzero((bound > 0) & (bound >= best.least))
            if not len(able):
                return
            if len(able) > step:
                able = able[np.argpartition(-bound[able], step)]
            chosen, rest = able[:step], able[step:]
            small = chosen[high[chosen] - low[chosen] <= leaf]
            if len(small):
                self._score_all(begin[:, small], end[:, small], best)
            large = chosen[high[chosen] - low[chosen] > leaf]
            at = split[large]
            here = terms[:, None] * self.size + at
            middle = np.searchsorted(self.keys, here)
            hit = (middle < len(self.keys)) & (self.keys[np.minimum(middle, len(self.keys) - 1)] == here)
            if len(large):
                scores = np.where(hit, self.impacts[np.minimum(middle, len(self.keys) - 1)], 0).sum(0)
                best.offer(scores, self.ids[at])
            new_begin = np.concatenate([begin[:, large], middle + hit], 1)
            new_end = np.concatenate([middle, end[:, large]], 1)
            new_bound, new_split = self._bounds(new_begin, new_end)
            low = np.concatenate([low[rest], low[large], at + 1])
            high = np.concatenate([high[rest], at, high[large]])
            begin, end = np.concatenate([begin[:, rest], new_begin], 1), np.concatenate([end[:, rest], new_end], 1)
            bound, split = np.concatenate([bound[rest], new_bound]), np.concatenate([split[rest], new_split])

    def _bounds(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per interval the sum of its terms' largest impacts, and the document with the largest of them."""
        if not begin.shape[1]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = self.largest(begin, end)
        values = np.where(top >= 0, self.impacts[top], 0)
        strongest = values.argmax(0)
        return values.sum(0), self.keys[top[strongest, np.arange(top.shape[1])]] % self.size

    def _score_all(self, begin: np.ndarray, end: np.ndarray, best: "Best") -> None:
        begin, length = begin.ravel(), (end - begin).ravel()
        starts = np.cumsum(length) - length
        entries = np.arange(length.sum()) + np.repeat(begin - starts, length)
        scores = np.zeros(self.size, np.int64)
        np.add.at(scores, self.keys[entries] % self.size, self.impacts[entries])
        able = np.flatnonzero((scores > 0) & (scores >= best.least))
        best.offer(scores[able], self.ids[able])


class Best:
    """The highest scores of one item so far; equal ones by ascending id."""

    __slots__ = ("top", "scores", "ids")

    def __init__(self, top: int) -> None:
        self.top = top
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A document needs at least this score to be among the best."""
        return int(self.scores[-1]) if len(self.scores) >= self.top else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        able = scores >= self.least
        if able.any():
            scores, ids = np.concatenate([self.scores, scores[able]]), np.concatenate([self.ids, ids[able]])
            order = np.lexsort((ids, -scores))[:self.top]
            self.scores, self.ids = scores[order], ids[order]


def search_shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, queries: list[tuple[int, np.ndarray]],
                  n_docs: int, n_terms: int, top: int) -> Iterator[pa.RecordBatch]:
    """The best documents of one task for each item."""
    best = [Best(top) for _ in queries]
    parts: list[tuple] = []
    docs = entries = 0

    def search_parts() -> None:
        ids, lengths, terms, times, held = (np.concatenate(columns) for columns in zip(*parts))
        shard = Shard(ids, lengths, np.repeat(np.arange(len(ids)), held), terms, times.astype(np.int64), weights, n_docs, n_terms)
        for (_, asked), found in zip(queries, best):
            shard.search(asked, found)

    for piece in pieces_of(batches, 2048):
        terms, times = (piece.column(name).to_pylist() for name in ("terms", "times"))
        held = np.array([len(t) // 4 for t in terms], np.int64)
        parts.append((piece.column("doc_id").fill_null(_NO_ID).to_numpy(), piece.column("n").to_numpy(),
                      np.frombuffer(b"".join(terms), np.int32), np.frombuffer(b"".join(times), np.int32), held))
        docs, entries = docs + len(held), entries + int(held.sum())
        if docs >= SHARD_DOCS or entries >= SHARD_ENTRIES:
            search_parts()
            parts, docs, entries = [], 0, 0
    if parts:
        search_parts()
    rows = np.repeat([row for row, _ in queries], [len(b.ids) for b in best]).astype(np.int64)
    ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, np.int64)
    scores = np.concatenate([b.scores for b in best]) if best else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], names=["row", "doc_id", "score"])


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each item of ``benchmark``."""
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = r"""
with low as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms, row_number() over () as r
  from documents),
ask as (
  select distinct i, item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select *, row_number() over () as i from benchmark)),
size as (select count(*) as n_docs, sum(len(terms))::bigint as n_terms from low where len(terms) > 0),
tf as (select r, term, count(*) as tf from (select r, unnest(terms) as term from low) group by r, term),
w as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w
      from tf, size where term in (select term from ask) group by term),
m as (select r, doc_id, 10 + (90 * len(terms) * n_docs) // n_terms as m from low, size where len(terms) > 0),
scored as (
  select i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from ask join w using (term) join tf using (term) join m using (r) group by all)
select item_id, rank, doc_id, score from (
  select *, (row_number() over (partition by i order by score desc, doc_id nulls last))::int as rank from scored where score > 0)
where rank <= 10
"""
