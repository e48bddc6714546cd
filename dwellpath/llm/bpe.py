"""Byte-level BPE by corpus-level merge replay.

A text is cut by the vocabulary's pattern into pieces.  The distinct pieces of a block of
documents form one flat sequence of symbols; an inverted index leads from each pair of
neighbouring symbols to its positions.  Merges are then applied in rank order, each to all
its positions at once, and only the neighbours of a merged pair are looked at again.  A
piece seen earlier in the same task is not replayed a second time.

All work is inside one map over the documents: nothing is shuffled, and memory is bounded
by the block of documents and a cache of limited size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellpath.llm.common import documents, free_name, pieces_of

BYTE_BPE = "byte_bpe_50k.tiktoken"
# A block's texts, and the pieces remembered from earlier blocks of a task.
BLOCK_BYTES = 4 << 20
CACHED_PIECES = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encodes distinct pieces, given the rank of every token (below 2 ** 16)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    merges[left << 16 | right] = rank
        self.pairs = np.array(sorted(merges), np.int64)
        self.pair_ranks = np.array([merges[pair] for pair in self.pairs.tolist()], np.int32)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces in one array, and where each piece's begin (one more at the end)."""
        whole = np.array([self.ranks.get(piece, -1) for piece in pieces], np.int32)
        rest = np.flatnonzero(whole < 0)
        ids, counts = self._replay([pieces[at] for at in rest.tolist()])
        lengths = np.ones(len(pieces), np.int64)
        lengths[rest] = counts
        starts = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(int(starts[-1]), np.int32)
        direct = np.flatnonzero(whole >= 0)
        out[starts[direct]] = whole[direct]
        taken = np.repeat(whole < 0, lengths)
        out[taken] = ids
        return out, starts

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of symbols, -1 where there is none."""
        code = left.astype(np.int64) << 16 | right
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where((self.pairs[at] == code) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def _replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge in rank order: ids of all pieces in a row, and how many each has.

        Of several places of one rank in a piece the leftmost merges first; should that
        create a pair of a lower rank, the lower one is merged before the other places.
        """
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(piece) for piece in pieces])
        begins = np.cumsum(sizes + 1) - sizes  # one free place before each piece
        total = int(sizes.sum()) + len(pieces) + 1
        symbol = np.full(total, -1, np.int32)  # -1 stands between pieces
        inside = np.ones(total, bool)
        inside[begins - 1] = inside[-1] = False
        symbol[inside] = self.bytes[raw]
        word = np.cumsum(~inside)
        following, preceding = np.arange(1, total + 1), np.arange(-1, total - 1)
        rank_at = np.append(self._rank(symbol[:-1], symbol[1:]), np.int32(-1))  # of the pair that begins there

        # the inverted index: rank of a pair -> its positions, in parts
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts)):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank].append(part)

        first = np.flatnonzero(rank_at >= 0)
        if len(first):
            enter(first, rank_at[first])
        while queue:
            rank = heapq.heappop(queue)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[rank_at[at] == rank]  # the others have merged with another neighbour
            if not len(at):
                continue
            right = following[at]
            if len(at) > 1 and (chained := right[:-1] == at[1:]).any():
                # in a run of overlapping places every second one merges
                begin = np.append(0, np.flatnonzero(~chained) + 1)
                offset = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
                at = at[offset % 2 == 0]
                right = following[at]
            merged = np.full(len(at), rank, np.int32)
            before, after = preceding[at], following[right]
            left_rank, right_rank = self._rank(symbol[before], merged), self._rank(merged, symbol[after])
            if len(at) > 1 and (((left_rank >= 0) & (left_rank < rank)) | ((right_rank >= 0) & (right_rank < rank))).any():
                leftmost = np.append(True, word[at[1:]] != word[at[:-1]])
                if not leftmost.all():
                    later = at[~leftmost]
                    at, right, merged, before, after, left_rank, right_rank = (
                        part[leftmost] for part in (at, right, merged, before, after, left_rank, right_rank))
                    enter(later, np.full(len(later), rank, np.int32))
            symbol[at], symbol[right] = rank, -2  # -2 is absorbed
            rank_at[right] = -1
            following[at], preceding[after] = after, at
            if len(at) > 1 and (after[:-1] == at[1:]).any():  # merged neighbours meet each other
                before, after = preceding[at], following[at]
                left_rank, right_rank = self._rank(symbol[before], merged), self._rank(merged, symbol[after])
            rank_at[before], rank_at[at] = left_rank, right_rank
            positions, ranks = np.concatenate([before, at]), np.concatenate([left_rank, right_rank])
            able = ranks >= 0
            if able.any():
                enter(positions[able], ranks[able])
        kept = symbol >= 0
        return symbol[kept], np.bincount(word[kept] - 1, minlength=len(pieces))


def encode(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, text: str = "text",
           ids: str = "token_ids") -> tuple[DataFrame, str]:
    """Add the token ids of each whole text; returns the frame and the new column's name.

    ``vocabulary`` is the path of a rank file on every executor.  A null or empty text has
    no tokens.  Texts and pieces may be of any length; equal texts get equal ids; other
    columns stay (a clash renames the new one).  Strings of special tokens are ordinary text.
    """
    column = free_name(docs, ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))])
    names, text_at = schema.fieldNames(), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, bounds in encode_blocks(batches, vocabulary, pattern, text_at):
            found = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=names)

    return docs.mapInArrow(run, schema), column


def encode_blocks(batches: Iterator[pa.RecordBatch], vocabulary: str, pattern: str,
                  text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time, the ids of all their texts, and where each text's begin (one more at the end)."""
    import regex
    replay, find = MergeReplay(read_ranks(vocabulary)), regex.compile(pattern).findall
    known: dict[str, int] = {}
    ids, starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
    for batch in pieces_of(batches, rows=1 << 14, size=BLOCK_BYTES):
        if len(known) > CACHED_PIECES:
            known, ids, starts = {}, ids[:0], starts[:1]
        had, rows = len(known), []
        for value in batch.column(text_at).to_pylist():
            rows.append(np.array([known.setdefault(piece, len(known)) for piece in find(value)] if value else [], np.int64))
        new = list(itertools.islice(known, had, None))
        new_ids, new_starts = replay.encode([piece.encode() for piece in new])
        ids, starts = np.concatenate([ids, new_ids]), np.concatenate([starts, starts[-1] + new_starts[1:]])
        for some in range(0, len(rows), 256):
            owned = rows[some:some + 256]
            pieces = np.concatenate(owned)
            values = _gathered(ids, starts[pieces], starts[pieces + 1] - starts[pieces])
            ends = np.append(0, np.cumsum(starts[pieces + 1] - starts[pieces]))
            yield batch.slice(some, len(owned)), values, ends[np.append(0, np.cumsum([len(row) for row in owned]))]


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts``, in a row."""
    return values[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]


class Strings:
    """A byte string per id, by which ids in a row become bytes in a row."""

    def __init__(self, strings: dict[int, bytes]) -> None:
        self.lengths = np.full(max(strings) + 1, -1, np.int64)
        self.lengths[list(strings)] = [len(value) for value in strings.values()]
        self.starts = np.zeros(len(self.lengths), np.int64)
        self.starts[list(strings)] = np.cumsum([0, *(len(value) for value in strings.values())])[:-1]
        self.values = np.frombuffer(b"".join(strings.values()), np.uint8)

    def of(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where those of each stretch of ``bounds`` begin."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.lengths) and (self.lengths[ids] >= 0).all()):
            raise ValueError("unknown token id")
        lengths = self.lengths[ids]
        return _gathered(self.values, self.starts[ids], lengths), np.append(0, np.cumsum(lengths))[bounds]


def decode(encoded: DataFrame, vocabulary: str, ids: str = "token_ids", out: str = "decoded") -> tuple[DataFrame, str]:
    """Add the bytes that the token ids stand for; null ids give no bytes, an unknown id fails."""
    column = free_name(encoded, out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(column, T.BinaryType())])
    names, ids_at = schema.fieldNames(), encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = Strings({rank: value for value, rank in read_ranks(vocabulary).items()})
        for batch in pieces_of(batches):
            lists = batch.column(ids_at)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("null token id")
            bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
            values, ends = strings.of(flat.to_numpy(), bounds)
            found = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=names)

    return encoded.mapInArrow(run, schema), column


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) encoded and decoded: counts and digests of both."""
    return encode_checked(docs.select("doc_id", "text"), vocabulary).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def encode_checked(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens``, and digests of the ids and of the bytes they decode to.

    Ids are decoded in the task that made them, so a text passes through one worker only.
    The digest of ids is that of their decimal forms, joined by a blank.  Clashing names of
    ``docs`` rename the new columns, which come last.
    """
    vocabulary = vocabulary or public_tokenizers.path(BYTE_BPE)
    names = [free_name(docs, name) for name in ("token_ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    kinds = (T.ArrayType(T.IntegerType()), T.LongType(), T.StringType(), T.StringType())
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)])
    text_at = docs.columns.index("text")

    def digests(strings: Strings, values: np.ndarray, bounds: np.ndarray, behind: int) -> pa.Array:
        made, ends = strings.of(values, bounds)
        whole, ends = memoryview(made), ends.tolist()
        return pa.array([hashlib.sha256(whole[a:max(a, b - behind)]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: value for value, rank in read_ranks(vocabulary).items()}
        restored, spelled = Strings(tokens), Strings({rank: b"%d " % rank for rank in tokens})
        for part, values, bounds in encode_blocks(batches, vocabulary, public_tokenizers.PATTERN, text_at):
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values)),
                 pa.array(np.diff(bounds).astype(np.int64)), digests(spelled, values, bounds, 1),
                 digests(restored, values, bounds, 0)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
