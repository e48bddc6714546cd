"""Approximate nearest neighbours by learned partitions.

A bounded sample of different vectors is linked into a neighbour graph, and the graph is
cut into parts of equal size with few links between them.  A small network learns from the
sample which parts a vector's neighbours lie in.  Every row of the table is then filed
under the part the network holds most probable for it, and a query is sent to several
most probable parts, where it meets every row by exact distance.

How far a query goes down its list of parts is not a constant: on vectors held back from
training, the probability mass is found within which ``COVERED`` of their neighbours in
the sample lie, and every query takes parts up to that mass.  On data without clusters
that is a large share of all parts.

Parts are dealt into chunks of bounded size on both sides, so neither a frequent vector nor
a popular part meets in one task.  Only the sample, its graph and the network pass through
the driver.

Vectors that are null, empty, zero, or hold a null or non-finite component take no part.
Vectors of different lengths have no distance; each length is searched for itself.  Rows are
searched and found row by row, so a repeated ``vec_id`` is answered once per row, and finds
its other rows.  A null ``vec_id`` is no query, and comes last among equal distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellpath.llm.common import table
from dwellpath.session import cut_lineage

NEIGHBOURS = 10
EVERY = 100

# The network and the parts are fitted on at most so many vectors, and so many bytes of them.
SAMPLE, SAMPLE_BYTES = 16_384, 32 << 20
# Sample vectors per part, and links per vector of the graph.
PART, LINKS = 128, 10
# A part may outgrow the mean size by this factor while links between parts are reduced.
SLACK, ROUNDS = 1.05, 12
HIDDEN, EPOCHS, BATCH, RATE = 128, 20, 512, 4e-3
# One in so many sample vectors is held back; the share of its neighbours that probing must cover.
HELD_BACK, COVERED = 8, 0.97

# Rows of a part that meet at a time: so many bytes of each side.
CHUNK_BYTES, QUERY_BYTES = 8 << 20, 2 << 20


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """The ``k`` nearest rows found for each row whose ``vec_id`` is divisible by ``every``.

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns are ignored.  Returns
    ``query_id, rank, vec_id, score``; the score is the Euclidean distance in double precision.
    """
    usable = _usable(vectors)
    sizes = usable.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    found = [_nearest_of(usable.where(F.size("embedding") == row["d"]), row["d"], row["n"], every, k) for row in sizes]
    if not found:
        schema = "query_id long, rank int, vec_id long, score double"
        return vectors.sparkSession.createDataFrame([], schema)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def _usable(vectors: DataFrame) -> DataFrame:
    kind = vectors.schema["embedding"].dataType.elementType
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    wrong = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("embedding").isNotNull() & ~F.coalesce(wrong, F.lit(True)) & F.exists("embedding", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _nearest_of(usable: DataFrame, width: int, rows: int, every: int, k: int) -> DataFrame:
    spark = usable.sparkSession
    router = fit(spark, sample_of(usable, width, rows))
    shared = spark.sparkContext.broadcast(router)
    kind = usable.schema["embedding"].dataType.simpleString()
    # rows get a number of their own, which must not change between the readers below
    filed = cut_lineage(usable.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        lambda batches: file_rows(batches, shared.value), f"row long, vec_id long, embedding {kind}, part int"))
    sizes = np.zeros(router.parts, np.int64)
    for counted in filed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per part
        sizes[counted["part"]] = counted["n"]
    routed = cut_lineage(filed.where(F.col("vec_id") % every == 0).select("row", "embedding").mapInArrow(
        lambda batches: route(batches, shared.value, sizes, k), f"row long, embedding {kind}, part int"))
    queries = routed.groupBy("part").agg(F.count(F.lit(1)).alias("asked"))
    bytes_each = 8 * width
    spread = filed.groupBy("part").agg(F.count(F.lit(1)).alias("held")).join(queries, "part").select(
        "part", F.ceil(F.col("held") * bytes_each / CHUNK_BYTES).cast("int").alias("chunks"),
        F.ceil(F.col("asked") * bytes_each / QUERY_BYTES).cast("int").alias("groups"))
    # a row meets every group of queries of its part, a query every chunk
    key = ["part", "chunk", "group"]
    chunk, group = (F.pmod(F.xxhash64("row"), F.col(n)).cast("int") for n in ("chunks", "groups"))
    held = filed.join(spread, "part").select(
        "part", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"),
        "row", "vec_id", "embedding")
    asked = routed.join(spread, "part").select(
        "part", group.alias("group"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        "row", "embedding")
    met = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(
        lambda one, two: meet(one, two, k), "query long, row long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy("score", F.asc_nulls_last("vec_id"), "row")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = filed.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sample_of(usable: DataFrame, width: int, rows: int) -> np.ndarray:
    """At most ``SAMPLE`` different vectors, chosen by a hash of their components."""
    wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    hashed = usable.select(F.xxhash64("embedding").alias("hash"), "embedding")
    if rows > wanted:
        hashed = hashed.where(F.pmod(F.col("hash"), F.lit(1_000_000)) < -(-1_000_000 * wanted // rows))
    chosen = hashed.groupBy("hash").agg(F.first("embedding").alias("embedding")).orderBy("hash").limit(wanted)
    return matrix(chosen.select("embedding").toArrow().column("embedding"))


@dataclass
class Router:
    """A network of one hidden layer from a vector to the probabilities of its neighbours' parts."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    mass: float = 1.0

    @property
    def parts(self) -> int:
        return len(self.weights[3])

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors - self.mean) / self.scale, -8, 8).astype(np.float32)

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        return _forward(self.inputs(vectors), self.weights)[1]


def _forward(inputs: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(inputs @ weights[0] + weights[1], 0)
    scores = hidden @ weights[2] + weights[3]
    scores = np.exp(scores - scores.max(1, keepdims=True))
    return hidden, scores / scores.sum(1, keepdims=True)


def fit(spark: SparkSession, sample: np.ndarray) -> Router:
    """Cut the sample's neighbour graph into parts, learn them, and measure how far queries must go."""
    count = len(sample)
    parts = 1 << max(0, round(np.log2(max(1, count / PART))))
    links = neighbour_graph(spark, sample)
    part = balanced_parts(sample, links, parts)
    # clipped components keep the mean and spread of very large values finite
    tame = np.clip(sample, -1e100, 1e100)
    scale = tame.std(0)
    held_back = np.arange(count) % HELD_BACK == 0
    targets = np.zeros((count, parts), np.float32)
    np.add.at(targets, (np.repeat(np.arange(count), links.shape[1]), part[links].ravel()), 1)
    targets[np.arange(count), part] += 1
    targets /= targets.sum(1, keepdims=True)
    router = Router(tame.mean(0), np.where(scale > 0, scale, 1.0), [])
    inputs = router.inputs(sample)
    learned = ~held_back if parts > 1 else np.ones(count, bool)
    router.weights = _train(inputs[learned], targets[learned])
    if parts > 1:
        router.mass = covering_mass(router.probabilities(sample), links, held_back)
    return router


def neighbour_graph(spark: SparkSession, sample: np.ndarray) -> np.ndarray:
    """For each sample vector the numbers of its ``LINKS`` nearest others; found in slices on the executors."""
    count, links = len(sample), min(LINKS, len(sample) - 1)
    graph = np.zeros((count, links), np.int64)
    if not links:
        return graph
    shared = spark.sparkContext.broadcast(sample)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        squares = (known * known).sum(1)
        for batch in batches:
            numbers = batch.column("id").to_numpy()
            for start in range(0, len(numbers), 256):
                some = numbers[start:start + 256]
                distance = squares[None, :] - 2 * (known[some] @ known.T)
                distance[np.arange(len(some)), some] = np.inf
                near = np.argpartition(np.nan_to_num(distance, nan=np.inf, posinf=np.inf), links - 1, 1)[:, :links]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(near.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["id", "near"])

    found = spark.range(0, count, 1, max(1, count // 1024)).mapInArrow(slices, "id long, near array<long>").toArrow()
    graph[found.column("id").to_numpy()] = matrix(found.column("near")).astype(np.int64)
    return graph


def balanced_parts(sample: np.ndarray, links: np.ndarray, parts: int) -> np.ndarray:
    """A part for each node of the graph: equal halves first, then moves that cut fewer links.

    The halves are made along the direction of greatest spread.  A node moves to the part
    that most of its links lead to, those that gain most first, as long as there is room.
    """
    count = len(sample)
    part = np.zeros(count, np.int64)
    draw = np.random.default_rng(1)
    tame = np.clip(sample, -1e100, 1e100)
    made = 1
    while made < parts:
        for old in range(made):
            members = np.flatnonzero(part == old)
            centred = tame[members] - tame[members].mean(0)
            direction = draw.standard_normal(sample.shape[1])
            for _ in range(8):
                direction = centred.T @ (centred @ direction)
                direction /= np.linalg.norm(direction) or 1.0
            order = np.argsort(centred @ direction, kind="stable")
            part[members[order[len(order) // 2:]]] += made
        made *= 2
    if parts == 1 or not links.shape[1]:
        return part
    source = np.repeat(np.arange(count), links.shape[1])
    ends = np.concatenate([source, links.ravel()]), np.concatenate([links.ravel(), source])
    room = int(np.ceil(SLACK * count / parts))
    for _ in range(ROUNDS):
        towards = np.zeros((count, parts), np.int32)
        np.add.at(towards, (ends[0], part[ends[1]]), 1)
        wish = towards.argmax(1)
        gain = towards[np.arange(count), wish] - towards[np.arange(count), part]
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if sizes[wish[node]] < room:
                sizes[part[node]] -= 1
                sizes[wish[node]] += 1
                part[node] = wish[node]
                moved += 1
        if not moved:
            break
    return part


def _train(inputs: np.ndarray, targets: np.ndarray) -> list[np.ndarray]:
    """Adam on the cross entropy between predicted and actual parts of the neighbours."""
    draw = np.random.default_rng(2)
    width, parts = inputs.shape[1], targets.shape[1]
    weights = [draw.standard_normal((width, HIDDEN)).astype(np.float32) * np.float32(np.sqrt(2 / width)),
               np.zeros(HIDDEN, np.float32),
               draw.standard_normal((HIDDEN, parts)).astype(np.float32) * np.float32(np.sqrt(1 / HIDDEN)),
               np.zeros(parts, np.float32)]
    if parts == 1:
        return weights
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = draw.permutation(len(inputs))
        for start in range(0, len(order), BATCH):
            some = order[start:start + BATCH]
            x = inputs[some]
            hidden, chance = _forward(x, weights)
            wrong = (chance - targets[some]) / len(some)
            back = (wrong @ weights[2].T) * (hidden > 0)
            step += 1
            for at, slope in enumerate((x.T @ back, back.sum(0), hidden.T @ wrong, wrong.sum(0))):
                first[at] = 0.9 * first[at] + 0.1 * slope
                second[at] = 0.999 * second[at] + 0.001 * slope * slope
                weights[at] = weights[at] - np.float32(rate) * (first[at] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[at] / (1 - 0.999 ** step)) + np.float32(1e-8))
    return [w.astype(np.float32) for w in weights]


def _in_order(chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts from the most probable on, and the mass that stands before each of them."""
    order = np.argsort(-chance, axis=1, kind="stable")
    mass = np.take_along_axis(chance, order, 1).astype(np.float64)
    return order, np.cumsum(mass, 1) - mass


def covering_mass(chance: np.ndarray, links: np.ndarray, held_back: np.ndarray) -> float:
    """The mass within which ``COVERED`` of the neighbours of the vectors held back are filed."""
    filed = chance.argmax(1)
    order, before = _in_order(chance[held_back])
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(before, np.take_along_axis(place, filed[links[held_back]], 1), 1)
    return float(np.quantile(needed, COVERED)) if needed.size else 1.0


def file_rows(batches: Iterator[pa.RecordBatch], router: Router) -> Iterator[pa.RecordBatch]:
    """Add to each row the part that is most probable for it."""
    for batch in batches:
        if batch.num_rows:
            part = router.probabilities(matrix(batch.column("embedding"))).argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("embedding"), pa.array(part.astype(np.int32))],
                names=["row", "vec_id", "embedding", "part"])


def route(batches: Iterator[pa.RecordBatch], router: Router, sizes: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Each query once for each of its parts: up to the covering mass, and on until they hold ``k`` rows beside it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        order, before = _in_order(router.probabilities(matrix(batch.column("embedding"))))
        held = sizes[order]
        needed = (before <= router.mass) | (np.cumsum(held, 1) - held <= k)
        query, place = np.nonzero(needed & (held > 0))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row").take(pa.array(query)), batch.column("embedding").take(pa.array(query)),
             pa.array(order[query, place].astype(np.int32))], names=["row", "embedding", "part"])


def meet(queries: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest of ``held`` for each query, by exact distance.

    Products of matrices narrow the candidates with a margin far beyond their rounding; what
    is left is measured component by component.
    """
    found: list[tuple[np.ndarray, ...]] = []
    if queries.num_rows and held.num_rows:
        asked, rows = queries.column("row").to_numpy(), held.column("row").to_numpy()
        names = held.column("vec_id").combine_chunks()
        unnamed, names = names.is_null().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy()
        q, c = matrix(queries.column("embedding")), matrix(held.column("embedding"))
        with np.errstate(over="ignore", invalid="ignore"):
            q2, c2 = (q * q).sum(1), (c * c).sum(1)
            for start in range(0, len(q), 64):
                some = slice(start, start + 64)
                near = np.nan_to_num(q2[some, None] + c2 - 2 * (q[some] @ c.T), nan=np.inf, posinf=np.inf)
                near[asked[some, None] == rows[None, :]] = np.nan
                last = min(k, near.shape[1]) - 1
                margin = np.nan_to_num(1e-9 * (q2[some] + c2.max()), posinf=0.0)
                at, other = np.nonzero(near <= (np.partition(near, last, 1)[:, last] + margin)[:, None])
                if last + 1 < k or np.isnan(np.partition(near, last, 1)[:, last]).any():
                    at, other = np.nonzero(~np.isnan(near))
                score = np.concatenate([np.zeros(0), *(
                    np.sqrt(((q[start + at[i:i + 65536]] - c[other[i:i + 65536]]) ** 2).sum(1))
                    for i in range(0, len(at), 65536))])
                order = np.lexsort((rows[other], names[other], unnamed[other], score, at))
                at, other, score = at[order], other[order], score[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                best = rank < k
                found.append((asked[start + at[best]], other[best], score[best]))
    query, other, score = (np.concatenate(columns) for columns in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return pa.table({
        "query": pa.array(query, pa.int64()), "row": held.column("row").take(pa.array(other, pa.int64())),
        "vec_id": held.column("vec_id").take(pa.array(other, pa.int64())), "score": pa.array(score, pa.float64())})


def op13_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of ``embeddings`` for every hundredth vector id."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
