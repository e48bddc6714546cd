"""Near-duplicate groups by an LSH forest over MinHash signatures.

Every text's set of word shingles gets a signature of MinHash values.  Texts with equal
sets are one class and go on as one row.  The forest consists of several orders of the
signature's values: in each order the classes are sorted, so that classes sharing a long
prefix, and hence probably most of their shingles, are neighbours.

First the neighbours in a few orders are compared on their full sets and joined into
components; a large group of near copies becomes one component through these chains, at a
cost in proportion to its size.  Then all orders are searched for pairs that lie in
different components but in one region, that is, share a prefix of ``MIN_DEPTH`` values.
The depth adapts: a region crowded with more than ``CROWD`` classes is cut by further
values until its parts are small, and neighbours in them, which share the longest
prefixes, are compared.

What that leaves open is settled on the shingles: the classes of crowded regions, and of
regions that two tasks share, if the region still holds several components.  Their sets
are ordered by how rare a shingle is among them; similar sets must share one of their
first shingles.  Sets first meet the most ordinary one of each shingle, which joins the
variants of a template at a cost in proportion to their number; then all sets of different
components that share a first shingle are compared, if they may be similar by their sizes,
the shingle's places, their signatures, and how many shingles of either a bit mask shows
to be missing in the other.

Sorting is by range over (order, signature, id), so that not even a group of a third of
all texts lands in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellpath.llm.common import documents, free_name, pieces_of, text_bytes
from dwellpath.llm.components import components
from dwellpath.session import cut_lineage

VALUES = 128  # MinHash values of a signature
ORDERS = 25  # sorted orders; their first MIN_DEPTH values are disjoint
MIN_DEPTH, MAX_DEPTH = 5, 16
CHAIN_ORDERS = 4
CROWD = 24
# Pairs agreeing in fewer of an order's MAX_DEPTH values are not worth a comparison: at a
# similarity of 0.8 that happens once in some ten thousand pairs, per order.
MIN_AGREE = 6
# Of the whole signature's values, similar pairs agree in 102 of 128 on average at 0.8; 80 is five deviations below.
MIN_ALIKE = 0.625
SIEVE_BITS = 23
SKETCH_BITS = 24  # at most; fuller counters make the order of shingles less telling, not the result
PART_ROWS = 1000  # sets of one shingle beyond this number are dealt to several parts
DEALS = 8  # over how many tasks the sets of one shingle go when they learn what is common to it
# Two bits of every value, in four numbers: of 128 such, similar pairs agree in 108.8 on average at 0.8, with a deviation of 4.
SKETCH = [f"s{k}" for k in range(4)]
MIN_SKETCH = 88
MASK = [f"m{k}" for k in range(8)]  # 512 bits, one or more of which each shingle of a set sets
BEFORE = 64  # rarer shingles of its set that a first shingle carries, so that a pair is compared at the first it shares

_CHUNK = 1 << 16
KNOWN_WORDS = 200_000  # whose hashes a task remembers, about 30 MB


def shingles_of(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of ``size`` words; fewer words are one shingle, none give none."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


def _shingle_hashes(words: list[bytes], size: int, known: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text."""
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(codes))
    if not width:
        return codes
    mixed = np.full(len(codes) - width + 1, width, np.uint64)
    for at in range(width):
        mixed = (mixed ^ codes[at:at + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``VALUES`` 16-bit values per non-empty set: minima of hashed shingles, hashed down."""
    draw = np.random.default_rng(20240607)
    multipliers = draw.integers(0, 1 << 31, (VALUES, 2), np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((len(sets), VALUES), np.uint32)
    at = 0
    while at < len(sets):
        until, held = at, 0
        while until < len(sets) and (held == 0 or held + len(sets[until]) <= _CHUNK):
            held += len(sets[until])
            until += 1
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:until - 1]])]).astype(np.int64)
        base = (np.concatenate(sets[at:until]) >> np.uint64(32)).astype(np.uint32)
        for value, (first, second) in enumerate(multipliers):
            hashed = base * first
            hashed ^= hashed >> np.uint32(15)
            hashed *= second
            out[at:until, value] = np.minimum.reduceat(hashed, starts)
        at = until
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    out *= np.uint32(0xC2B2AE35)
    return (out >> np.uint32(16)).astype(">u2")


def _sign(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        known = _WordHashes()
        for batch in pieces_of(batches):
            if len(known) > KNOWN_WORDS:
                known.clear()
            sets = [_shingle_hashes(text.lower().split(), size, known) for text in text_bytes(batch.column(1))]
            filled = [s for s in sets if len(s)]
            rows = iter(_signatures(filled)) if filled else iter(())
            signatures = [next(rows).tobytes() if len(s) else None for s in sets]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(signatures, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "digest", "signature"])

    return sign


def _value_orders() -> np.ndarray:
    """Which signature values each order sorts by: its own first ``MIN_DEPTH``, then others at random."""
    draw = np.random.default_rng(77)
    rows = []
    for order in range(ORDERS):
        own = np.arange(order * MIN_DEPTH, (order + 1) * MIN_DEPTH)
        others = draw.permutation(np.setdiff1d(np.arange(VALUES), own))[:MAX_DEPTH - MIN_DEPTH]
        rows.append(np.concatenate([own, others]))
    return np.array(rows)


def _sorted_orders(classes: DataFrame, orders: int) -> DataFrame:
    """``classes`` (``rep``, ``root``, ``signature``) once per order, sorted by range."""
    chosen = _value_orders()[:orders]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, rows=4096):
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u2").reshape(-1, VALUES)
            for order, columns in enumerate(chosen):
                keys = np.ascontiguousarray(values[:, columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), order, np.int32)),
                     pa.array([row.tobytes() for row in keys], pa.binary()), batch.column(0), batch.column(1)],
                    names=["order", "key", "rep", "root"])

    rows = classes.select("rep", "root", "signature").mapInArrow(spread, "order int, key binary, rep long, root long")
    return rows.repartitionByRange("order", "key", "rep").sortWithinPartitions("order", "key", "rep")


_PAIRS = "a long, b long, region long"  # a pair without a region, or a class, null and a region that is not settled


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], names=["a", "b", "region"])


def _marks(rows, lo: int, hi: int) -> pa.RecordBatch:
    """The classes of one region, to be looked at again."""
    import xxhash
    order, keys, reps, _ = rows
    region = xxhash.xxh64_intdigest(keys[lo, :MIN_DEPTH].tobytes(), seed=int(order[lo])) - (1 << 63)
    return pa.RecordBatch.from_arrays(
        [pa.array(reps[lo:hi]), pa.nulls(hi - lo, pa.int64()), pa.array(np.full(hi - lo, region, np.int64))],
        names=["a", "b", "region"])


def _read_sorted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, MAX_DEPTH).astype(np.int32)
    return batch.column(0).to_numpy(), keys, batch.column(2).to_numpy(), batch.column(3).to_numpy()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours with a common prefix of ``MIN_DEPTH``; the last row of a batch meets the next batch."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _read_sorted(batch)
        if last is not None:
            rows = tuple(np.concatenate([end, new]) for end, new in zip(last, rows))
        last = tuple(part[-1:] for part in rows)
        order, keys, reps, _ = rows
        near = (order[1:] == order[:-1]) & (keys[1:, :MIN_DEPTH] == keys[:-1, :MIN_DEPTH]).all(axis=1)
        near &= (keys[1:] == keys[:-1]).sum(axis=1) >= MIN_AGREE
        near &= reps[1:] != reps[:-1]
        yield _pairs(reps[:-1][near], reps[1:][near])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in one region but in different components.

    A region is held while it is read; beyond ``HELD`` rows its part so far is searched and
    its last rows stay for the next, so memory has a bound.  Such a region, and those at the
    ends of a task's rows, are marked as unsettled.
    """
    held, part = None, True  # whether the first region may have begun before
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _read_sorted(batch)
        if held is not None:
            rows = tuple(np.concatenate([old, new]) for old, new in zip(held, rows))
        order, keys, _, _ = rows
        same = (order[1:] == order[:-1]) & (keys[1:, :MIN_DEPTH] == keys[:-1, :MIN_DEPTH]).all(axis=1)
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        open_from = int(starts[-1])
        if len(order) - open_from > HELD:
            yield from _search(rows, np.concatenate([starts, [len(order)]]))
            if part and open_from:
                yield _marks(rows, 0, int(starts[1]))
            yield _marks(rows, open_from, len(order))
            held, part = tuple(column[-CROWD:] for column in rows), True
        else:
            yield from _search(rows, starts)
            if part and open_from:
                yield _marks(rows, 0, int(starts[1]))
                part = False
            held = tuple(column[open_from:] for column in rows)
    if held is not None:
        yield from _search(held, np.array([0, len(held[0])]))
        yield _marks(held, 0, len(held[0]))


HELD = 200_000


def _search(rows, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    _, keys, reps, roots = rows
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        apart = roots[a] != roots[b]
        a, b = a[apart], b[apart]
        if len(a):
            alike = (keys[a] == keys[b]).sum(axis=1) >= MIN_AGREE
            if alike.any():
                found.append((reps[a[alike]], reps[b[alike]]))

    stack = [(int(lo), int(hi), MIN_DEPTH) for lo, hi in zip(bounds[:-1], bounds[1:]) if hi - lo > 1]
    while stack:
        lo, hi, depth = stack.pop()
        part = roots[lo:hi]
        if (part == part[0]).all():
            continue
        if hi - lo <= CROWD:
            if depth == MIN_DEPTH:
                a, b = np.triu_indices(hi - lo, 1)
                compare(a + lo, b + lo)
            else:
                at = np.arange(lo, hi - 1)
                compare(at, at + 1)
            continue
        if depth == MIN_DEPTH:
            yield _marks(rows, lo, hi)
        if depth < MAX_DEPTH:
            cuts = np.flatnonzero(keys[lo + 1:hi, depth] != keys[lo:hi - 1, depth]) + lo + 1
            edges = [lo, *cuts.tolist(), hi]
            stack.extend((s, e, depth + 1) for s, e in zip(edges[:-1], edges[1:]) if e - s > 1)
    if found:
        yield _pairs(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))


def _confirm(size: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            keep, last, mine = [], None, set()
            for one, other in zip(text_bytes(batch.column(2)), text_bytes(batch.column(3))):
                if one is not last and one != last:
                    last, mine = one, shingles_of(one.lower().split(), size)
                theirs = shingles_of(other.lower().split(), size)
                common = len(mine & theirs)
                keep.append(bool(common) and 100 * common >= percent * (len(mine) + len(theirs) - common))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return confirm


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose whole signatures agree well enough for a comparison of full sets."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u2").reshape(-1, VALUES) for k in (2, 3))
                kept = pa.array((one == other).sum(axis=1) >= MIN_ALIKE * VALUES)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    sides = [classes.select(F.col("rep").alias(side), F.col("signature").alias(f"of_{side}")) for side in "ab"]
    met = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "of_a", "of_b")
    return cut_lineage(met.mapInArrow(compare, "a long, b long").distinct())


def _places(ids: np.ndarray) -> list[np.ndarray]:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return [(mixed >> np.uint64(64 - SIEVE_BITS)).astype(np.int64), (mixed & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)]


def _sieved(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """Texts without most of those whose id is not in ``ends``, so that they need not be shuffled.

    A bit set of fixed size, so it may let others pass; only the join that follows decides.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << SIEVE_BITS, bool)
        for batch in batches:
            for places in _places(batch.column(0).to_numpy()):
                flags[places] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for row in ends.coalesce(16).mapInArrow(mark, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in pieces_of(batches, rows=4096):
            one, two = (held[place >> 3] >> (7 - (place & 7)) & 1 for place in _places(batch.column(0).to_numpy()))
            yield batch.filter(pa.array((one & two).astype(bool)))

    return texts.select("doc_id", "text").mapInArrow(sieve, "doc_id long, text string")


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough.

    Signatures settle most of the others.  Texts meet their pairs in two equi-joins, each
    text shipped once per pair at most; texts without a pair are left behind before that.
    """
    pairs = _alike(pairs, classes)
    ends = cut_lineage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    wanted = cut_lineage(_sieved(texts, ends).join(ends, "doc_id", "left_semi"))
    first = pairs.join(wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return cut_lineage(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size, percent), "a long, b long").distinct())


def _rooted(frame: DataFrame, roots: DataFrame) -> DataFrame:
    """``frame`` with ``root``, the component of its ``rep``."""
    return frame.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _unsettled(marks: DataFrame, roots: DataFrame) -> DataFrame:
    """``rep`` of the marked classes (``rep``, ``region``) whose region holds several components."""
    placed = _rooted(marks, roots)
    several = placed.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return cut_lineage(placed.join(several, "region", "left_semi").select("rep").distinct())


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """In how many sets each hashed shingle occurs, 0 for one; shingles may share a counter."""
    total = sets.agg(F.sum(F.octet_length("shingles") / 8).cast("long")).first()[0] or 0
    bits = min(SKETCH_BITS, max(12, total.bit_length() + 1))
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a table of all counters in every task would take more memory than the slots themselves
        held = [np.empty(0, np.int64)]
        for batch in pieces_of(batches):
            held.append((np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64) >> shift).astype(np.int64))
            if sum(map(len, held)) > 16 * _CHUNK:
                yield from told(held)
                held = held[:1]
        yield from told(held)

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slots, numbers = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(slots), _CHUNK):
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots[at:at + _CHUNK]), pa.array(numbers[at:at + _CHUNK])], names=["slot", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, counts = batch.column(0).to_numpy(), np.minimum(batch.column(1).to_numpy(), 65535)
            yield pa.RecordBatch.from_arrays(
                [pa.array([slots.astype("<i4").tobytes()], pa.binary()), pa.array([counts.astype("<u2").tobytes()], pa.binary())],
                names=["slots", "counts"])

    summed = sets.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    out = np.zeros(1 << bits, np.uint16)
    for row in summed.mapInArrow(pack, "slots binary, counts binary").toLocalIterator():
        out[np.frombuffer(row["slots"], "<i4")] = np.frombuffer(row["counts"], "<u2")
    return out


def _sketches(signatures: list[bytes]) -> np.ndarray:
    values = np.frombuffer(b"".join(signatures), ">u2").reshape(-1, VALUES)
    bits = np.stack([values >> 1 & 1, values & 1], axis=2).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1).view(">i8").astype(np.int64)


def _masks(sets: list[np.ndarray]) -> np.ndarray:
    bits = np.zeros((len(sets), 64 * len(MASK)), np.uint8)
    lengths = [len(shingles) for shingles in sets]
    places = (np.concatenate(sets) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)
    bits[np.repeat(np.arange(len(sets)), lengths), places.astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def _overlap_at_most():
    """No more shingles than these are in both ``x`` and ``y``: a bit that only one of them set stands for one of its own."""
    def own(one: str, other: str):
        alone = (F.col(f"{one}.{name}").bitwiseAND(F.bitwise_not(f"{other}.{name}")) for name in MASK)
        return F.col(f"{one}.size") - sum(F.bit_count(a) for a in alone)

    return F.least(own("x", "y"), own("y", "x"))


def _agreeing():
    """In how many values the sketches of two sets, ``x`` and ``y``, agree."""
    odd = F.lit(0x5555555555555555)
    apart = [F.col(f"x.{name}").bitwiseXOR(F.col(f"y.{name}")) for name in SKETCH]
    return VALUES - sum(F.bit_count((a.bitwiseOR(F.shiftright(a, 1))).bitwiseAND(odd)) for a in apart)


def _first_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each set, one of which it shares with every set similar to it.

    Per shingle also ``place`` among those of its set that others hold and their number
    ``common``, the set's ``size``, how ``ordinary`` its shingles are, its sketch and mask,
    and the shingles ``before`` it, up to ``BEFORE``.
    """
    counts = _shingle_counts(sets)
    shift, shared = np.uint64(65 - len(counts).bit_length()), sets.sparkSession.sparkContext.broadcast(counts)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            out, every = [], [np.frombuffer(packed, np.uint64) for packed in batch.column(1).to_pylist()]
            sketches = np.hstack([_sketches(batch.column(2).to_pylist()), _masks(every)]) if every else []
            for rep, shingles, sketch in zip(batch.column(0).to_pylist(), every, sketches):
                held = shared.value[(shingles >> shift).astype(np.int64)]
                size, alone = len(shingles), int((held == 0).sum())
                # fewer in common than percent of the set are too few, so one of the others is
                first = size + 1 - -(-percent * size // 100)
                if first > alone:
                    chosen = shingles[np.lexsort((shingles, held))[alone:first]]
                    out.append((chosen.view(np.int64), rep, size, size - alone, float(np.log(held + 1.0).mean()), *sketch))
            if out:
                lengths = [len(row[0]) for row in out]
                wide = [np.repeat(np.array(column), lengths) for column in list(zip(*out))[1:]]
                place = np.concatenate([np.arange(n) for n in lengths])
                held_back = np.concatenate([row[0][:min(k, BEFORE)] for row in out for k in range(len(row[0]))])
                before = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.minimum(place, BEFORE))]), pa.int32()), pa.array(held_back))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([row[0] for row in out])), *map(pa.array, wide[:3]), pa.array(place), *map(pa.array, wide[3:]), before],
                    names=["shingle", "rep", "size", "common", "place", "ordinary", *SKETCH, *MASK, "before"])

    return cut_lineage(sets.select("rep", "shingles", "signature").mapInArrow(
        choose, "shingle long, rep long, size long, common long, place long, ordinary double, " + ", ".join(
            f"{s} long" for s in SKETCH + MASK) + ", before array<long>"))


def _rest(unsettled: DataFrame, links: DataFrame, tested: DataFrame, classes: DataFrame, texts: DataFrame, size: int,
          percent: int) -> DataFrame:
    """``links`` with those that join the components of ``unsettled`` classes."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in pieces_of(batches):
            if len(known) > KNOWN_WORDS:
                known.clear()
            sets = [_shingle_hashes(text.lower().split(), size, known).tobytes() for text in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    ends = unsettled.select(F.col("rep").alias("doc_id"))
    wanted = _sieved(texts, ends).join(ends, "doc_id", "left_semi").select("doc_id", "text")
    sets = cut_lineage(wanted.mapInArrow(hashed, "rep long, shingles binary").where(F.octet_length("shingles") > 0).join(
        classes.select("rep", "signature"), "rep"))
    first = _first_shingles(sets, percent)

    def near(one: str, other: str):
        a, b = f"{one}.size", f"{other}.size"
        return (F.col(a) * percent <= F.col(b) * 100) & (F.col(b) * percent <= F.col(a) * 100)

    def pair(one: str, other: str) -> list:
        return [F.least(f"{one}.rep", f"{other}.rep").alias("a"), F.greatest(f"{one}.rep", f"{other}.rep").alias("b")]

    def may_link(earlier):
        """``earlier``: how many shingles before this one may be in both sets."""
        most = earlier + F.least(F.col("x.common") - F.col("x.place"), F.col("y.common") - F.col("y.place"))
        needed = (F.col("x.size") + F.col("y.size")) * percent
        return (F.col("x.root") != F.col("y.root")) & near("x", "y") & (most * (100 + percent) >= needed) & (
            _agreeing() >= MIN_SKETCH) & (_overlap_at_most() * (100 + percent) >= needed)

    def told(rows: DataFrame, of_shingles: DataFrame) -> DataFrame:
        """``rows`` as x beside what is known of their shingle as y; a shingle of many sets is dealt over tasks."""
        dealt = of_shingles.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
        return rows.withColumn("deal", F.pmod(F.xxhash64("rep"), F.lit(DEALS)).cast("int")).alias("x").join(
            dealt.alias("y"), ["shingle", "deal"])

    placed = cut_lineage(_rooted(first.drop("before"), components(links)))
    hubs = placed.groupBy("shingle").agg(
        F.max(F.struct("ordinary", "rep", "root", "size", "place", "common", *SKETCH, *MASK)).alias("h"), F.min("root").alias("low"), F.max("root").alias("high"))
    to_hubs = cut_lineage(told(placed, hubs.where("low < high").select("shingle", "h.*")).where(
        may_link(F.least("x.place", "y.place"))).select(*pair("x", "y")).distinct().join(tested, ["a", "b"], "left_anti"))
    links = links.unionByName(_links(to_hubs, classes, texts, size, percent))

    placed = cut_lineage(_rooted(first, components(links)))
    # of two components at least one is not the commonest of a shingle, so pairs begin there
    commonest = placed.groupBy("shingle", "root").count().groupBy("shingle").agg(
        F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("rows"), F.count(F.lit(1)).alias("roots")).where(
        "roots > 1").select("shingle", F.col("most.root").alias("main"), F.ceil(F.col("rows") / PART_ROWS).alias("parts"))
    dealt = cut_lineage(told(placed, commonest).drop("deal"))
    all_of = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    some_of = dealt.where("root <> main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # every shingle two sets share brings them together, but only the first of them in the common order makes a pair
    earlier = F.when(F.greatest("x.place", "y.place") > BEFORE, F.least("x.place", "y.place")).otherwise(0)
    met = some_of.alias("x").join(all_of.alias("y"), ["shingle", "part"]).where(
        may_link(earlier) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
        & ~F.arrays_overlap("x.before", "y.before"))
    rest = met.select(*pair("x", "y")).distinct().join(tested.unionByName(to_hubs), ["a", "b"], "left_anti")
    return links.unionByName(_links(rest, classes, texts, size, percent))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Groups of near duplicates among ``docs`` (``doc_id`` long, ``text``), one row per row.

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (smallest id that links reach) and
    ``kept`` (the id is that of its component).  Two texts are linked if the Jaccard
    similarity of their sets of ``shingle_words``-word shingles, A-Z lower-cased, is at
    least ``similarity``; fewer words than a shingle's are one shingle.  A text without
    words is linked with nothing.  A row without an id is linked with nothing, has no
    component and is kept.  Equal texts have one component; rows sharing an id are
    linked through their texts.
    """
    return _judged(docs, shingle_words, similarity).drop("text_hash")


def _judged(docs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The rows of :func:`near_duplicates`, each with a hash of its text."""
    percent = round(100 * similarity)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = cut_lineage(source.mapInArrow(
        _sign(shingle_words), "doc_id long, text_hash long, n_shingles long, digest binary, signature binary"))
    classes = cut_lineage(signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("signature").alias("signature")))
    whole = source.where("text is not null and doc_id is not null")

    alone = classes.select("rep", F.col("rep").alias("root"), "signature")
    tested = cut_lineage(_sorted_orders(alone, CHAIN_ORDERS).mapInArrow(_chain, _PAIRS).select("a", "b").distinct())
    links = _links(tested, classes, whole, shingle_words, percent)
    roots = cut_lineage(components(links))
    placed = _rooted(classes.select("rep", "signature"), roots)
    met = cut_lineage(_sorted_orders(placed, ORDERS).mapInArrow(_regions, _PAIRS).distinct())
    pairs = cut_lineage(met.where("region is null").select("a", "b").join(tested, ["a", "b"], "left_anti"))
    links = cut_lineage(links.unionByName(_links(pairs, classes, whole, shingle_words, percent)))
    roots = cut_lineage(components(links))
    unsettled = _unsettled(met.where("region is not null").select(F.col("a").alias("rep"), "region"), roots)
    if unsettled.limit(1).count():
        links = _rest(unsettled, links, tested.unionByName(pairs), classes, whole, shingle_words, percent)
        roots = cut_lineage(components(links))
    rooted = classes.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("root", "rep").alias("component_id"))
    named = signed.select("doc_id", "text_hash", "n_shingles", "digest").join(rooted, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the documents whose group of near duplicates has one of a smaller id.

    Of rows that share an id each different text is judged by itself, and stays if its
    group's smallest id is its own; rows equal in id and text are one.
    """
    judged = cut_lineage(_judged(docs, shingle_words, similarity))
    hashed, number = free_name(docs, "text_hash"), F.col("doc_id").cast("long")
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    marked = docs.withColumn(hashed, F.xxhash64("text"))
    kept = marked.join(gone, (number == F.col("gone_id")) & (F.col(hashed) == F.col("gone_hash")), "left_anti").select(*docs.columns)
    repeated = judged.where("doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1")
    if repeated.limit(1).count():
        kept = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return kept


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle_words=2)
