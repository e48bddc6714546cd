"""Benchmark decontamination by a broadcast set of word windows.

Every benchmark item is cut into windows of ``ngram`` words.  Their hashes travel to all
tasks; a task slides over the words of its documents, looks up one rolling hash per
position and confirms each match on the words themselves.

The set is broadcast in blocks of at most ``BLOCK_WORDS`` benchmark words, one pass over
the documents per block, so its size in memory has a bound however large the benchmark is.
No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellpath.llm.common import documents, free_name, pieces_of, table, text_bytes

BLOCK_WORDS = 2_000_000

_FILTER_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_KNOWN_WORDS = 1_000_000

# Digits, letters and everything beyond ASCII belong to words; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Windows:
    """The windows of a block of benchmark items, by length."""

    items: dict[tuple[bytes, ...], list[str]]
    hashes: dict[int, np.ndarray]


def windows_of(rows: list[tuple[str, bytes]], ngram: int) -> Windows:
    """An item shorter than ``ngram`` is one window; an item without words has none."""
    items: dict[tuple[bytes, ...], list[str]] = {}
    for name, text in rows:
        words = words_of(text)
        length = min(ngram, len(words))
        for start in range(len(words) - length + 1 if words else 0):
            names = items.setdefault(tuple(words[start:start + length]), [])
            if name not in names:
                names.append(name)
    hashes: dict[int, list[np.ndarray]] = {}
    known = _WordHashes()
    for window in items:
        codes = known.of(window)
        hashes.setdefault(len(window), []).append(_rolling(codes, len(window)))
    return Windows(items, {length: np.unique(np.concatenate(found)) for length, found in hashes.items()})


class _WordHashes(dict):
    """Word to 64-bit hash, forgotten when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code

    def of(self, words) -> np.ndarray:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    grow, shrink = np.full(count, _BASE), np.full(count, inverse)
    grow[:1] = shrink[:1] = 1
    return np.cumprod(grow, dtype=np.uint64), np.cumprod(shrink, dtype=np.uint64)


def _rolling(codes: np.ndarray, length: int, powers: tuple[np.ndarray, np.ndarray] | None = None,
             sums: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``length`` words from each position, from prefix sums of word hash times base power."""
    grow, shrink = powers if powers is not None else _powers(len(codes))
    if sums is None:
        sums = _prefix_sums(codes, grow)
    return (sums[length:] - sums[:-length]) * shrink[:len(codes) - length + 1]


def _prefix_sums(codes: np.ndarray, grow: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * grow[:len(codes)], dtype=np.uint64)])


def _scan(texts: list[bytes], windows: Windows, known: _WordHashes,
          filters: dict[int, np.ndarray]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: its number of words, the word spans that windows cover, and the items hit."""
    words = [words_of(text) for text in texts]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    results: list[tuple[int, list[tuple[int, int]], set[str]]] = [(len(w), [], set()) for w in words]
    total = int(bounds[-1])
    if not total or not windows.items:
        return results
    codes = known.of([word for own in words for word in own])
    powers = _powers(total)
    sums = _prefix_sums(codes, powers[0])
    shift = np.uint64(64 - _FILTER_BITS)
    for length, hashes in windows.hashes.items():
        if length > total:
            continue
        rolled = _rolling(codes, length, powers, sums)
        maybe = np.flatnonzero(filters[length][(rolled >> shift).astype(np.int64)])
        maybe = maybe[np.isin(rolled[maybe], hashes)]
        owners = np.searchsorted(bounds, maybe, "right") - 1
        inside = maybe + length <= bounds[owners + 1]
        for owner, at in zip(owners[inside].tolist(), (maybe - bounds[owners])[inside].tolist()):
            names = windows.items.get(tuple(words[owner][at:at + length]))
            if names is not None:
                results[owner][1].append((at, at + length))
                results[owner][2].update(names)
    return results


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _filters(windows: Windows) -> dict[int, np.ndarray]:
    """One flag per leading bits of a hash; most positions are dismissed by one look at it."""
    shift, filters = np.uint64(64 - _FILTER_BITS), {}
    for length, hashes in windows.hashes.items():
        flags = np.zeros(1 << _FILTER_BITS, bool)
        flags[(hashes >> shift).astype(np.int64)] = True
        filters[length] = flags
    return filters


def _blocks(items: DataFrame, id_column: str, text_column: str) -> list[DataFrame]:
    """Parts of the benchmark of about ``BLOCK_WORDS`` words each (more only for one giant item)."""
    rows = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("item"),
                        F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = int(size // (6 * BLOCK_WORDS)) + 1
    if count == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) for k in range(count)]


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
              item_text: str = "text", ngram: int = 13, hits: str = "hits") -> tuple[DataFrame, str]:
    """Add a struct column of contamination marks; returns the frame and the column's name.

    ``n_words``: words of the text; ``starts``/``ends``: the word spans covered by any window,
    merged and in order; ``items``: ids (as text, sorted) of items with an occurring window.
    A null text has no words and no marks; a null item id reads ``null``; equal item ids are
    one item; equal rows are marked alike; columns of ``docs`` stay as they are (a clash renames
    the new column).  Without items nothing is hit.
    """
    column = free_name(docs, hits)
    out = docs
    for number, block in enumerate(_blocks(items, item_id, item_text)):
        windows = windows_of([(r["item"], bytes(r["text"])) for r in block.collect()], ngram)
        shared = docs.sparkSession.sparkContext.broadcast(windows)
        schema = T.StructType([*docs.schema.fields, T.StructField(column, HITS)])
        out = out.mapInArrow(_marker(shared, docs.columns.index(text), bool(number), schema.fieldNames()), schema)
    return out, column


def _marker(shared, text_at: int, extend: bool, names_out: list[str]):
    kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
                      ("items", pa.list_(pa.string()))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, known = shared.value, _WordHashes()
        filters = _filters(windows)
        for batch in pieces_of(batches):
            earlier = batch.column(batch.num_columns - 1).to_pylist() if extend else [None] * batch.num_rows
            marks = []
            for (n_words, spans, names), old in zip(
                    _scan(text_bytes(batch.column(text_at)), windows, known, filters), earlier):
                if old:
                    spans, names = spans + list(zip(old["starts"], old["ends"])), names | set(old["items"])
                spans = _merged(spans)
                marks.append({"n_words": n_words, "starts": [s for s, _ in spans], "ends": [e for _, e in spans],
                              "items": sorted(names)})
            columns = batch.columns[:-1] if extend else batch.columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array(marks, kind)], names=names_out)

    return mark


def n_hit(hits: str) -> Column:
    return F.aggregate(F.zip_with(F.col(f"{hits}.starts"), F.col(f"{hits}.ends"), lambda s, e: (e - s).cast("long")),
                       F.lit(0).cast("long"), lambda a, b: a + b)


def is_contaminated(hits: str, share: float = 0.05) -> Column:
    """At least ``share`` (one in 20) of the words are hit, and at least one is."""
    inverse = round(1 / share)
    return (n_hit(hits) > 0) & (inverse * n_hit(hits) >= F.col(f"{hits}.n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, ngram: int = 13, share: float = 0.05) -> DataFrame:
    """Documents that are not contaminated, with the columns of ``docs``.  Null texts stay."""
    marked, hits = find_hits(docs, items, ngram=ngram)
    return marked.where(~is_contaminated(hits, share)).select(*docs.columns)


def cut_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", ngram: int = 13) -> DataFrame:
    """All documents with the hit words taken out of their texts, and the separators behind each cut span.

    What is left keeps its own case and spacing.  Null stays null.
    """
    marked, hits = find_hits(docs, items, text, ngram=ngram)
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            marks = batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if value is None else _without(value.encode(), mark) for value, mark in
                     zip(batch.column(at).to_pylist(), marks)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return marked.mapInArrow(cut, docs.schema)


def _without(text: bytes, mark: dict) -> str:
    if not mark["starts"]:
        return text.decode()
    folded, at, ends = text.translate(_FOLD), 0, []
    begins = []
    while at < len(folded):
        if folded[at] == 32:
            at += 1
            continue
        end = folded.find(b" ", at)
        end = len(folded) if end < 0 else end
        begins.append(at)
        ends.append(end)
        at = end
    out, done = [], 0
    for start, end in zip(mark["starts"], mark["ends"]):
        out.append(text[done:begins[start]])
        done = begins[end] if end < len(begins) else len(text)
    return b"".join([*out, text[done:]]).decode()


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, hits = find_hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return marked.select(
        "doc_id", F.col(f"{hits}.n_words").alias("n_words"), n_hit(hits).alias("n_hit"),
        F.size(f"{hits}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{hits}.items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(hits).alias("contaminated"))
