"""Grouping the stops of a user into places.

Two stops belong together when a chain of stops, each within the radius of the next,
connects them.  Stops are first put into grid cells so small that the stops of a cell are
always connected; a place visited a million times is then one cell.  What remains is to
find which neighbouring cells touch, and to follow the touching cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellpath.functions.geo import haversine_m
from dwellpath.functions.ranking import rank_in_time
from dwellpath.params import EARTH_RADIUS_M
from dwellpath.schema import CLUSTERED_STOPS, require_columns
from dwellpath.session import cut_for_joins, cut_lineage

# Fixed value: the clustering radius in radians on the unit sphere (200 m on Earth).
CLUSTER_RADIUS_RAD = 3.1392246115209545e-05
CLUSTER_RADIUS_M = CLUSTER_RADIUS_RAD * EARTH_RADIUS_M

# A cell is cut into SPLIT x SPLIT boxes each time its distance to a neighbour is undecided.
SPLIT = 4
# Box bounds closer than this to the radius are settled by looking at smaller boxes.
TOLERANCE_M = 1e-6

# Cells along the side of a region.  Touching cells are first followed region by region, so a task
# holds at most REGION x REGION cells of one user, however often they were visited.
REGION = 512

_CELL_STRIDE = 1 << 32


def cluster_stops(stops: DataFrame, radius_m: float = CLUSTER_RADIUS_M) -> DataFrame:
    """Add ``cluster_label``, numbered per user by each cluster's earliest stop.

    The stops and then their cells are written to the checkpoint folder, because the steps
    below read them several times.  All further work is on cells, until one join hands
    the labels back to the stops.
    """
    require_columns(stops, "user_id", "t_start", "t_end", "lat", "lon")
    grid = _Grid(radius_m)
    stops = cut_lineage(stops.drop("cluster_label"))
    celled = grid.assign(stops)
    cells = cut_for_joins(_cells_of(celled))
    roots = _components(_touching_cells(celled, cells, grid))
    rooted = cells.join(roots, ["user_id", "_cell"], "left").select(
        "user_id", "_cell", *_FIRST, F.coalesce("_root", "_cell").alias("_root"))
    clusters = rooted.groupBy("user_id", "_root").agg(*_first_of())
    labels = rooted.join(_numbered(clusters, "_root"), ["user_id", "_root"]).select("user_id", "_cell", "cluster_label")
    return celled.join(labels, ["user_id", "_cell"]).select(*stops.columns, "cluster_label")


# The columns that order the stops of a user, and names for those of a cluster's first stop.
_ORDER = ["t_start", "t_end", "lat", "lon"]
_FIRST = [f"_first_{name}" for name in _ORDER]


def _first_of(columns: list[str] = _FIRST) -> list[Column]:
    """The lowest ``columns`` in order, as plain columns."""
    return [F.min(F.struct(*columns))[name].alias(first) for name, first in zip(columns, _FIRST)]


def _cells_of(celled: DataFrame, *more: Column) -> DataFrame:
    return celled.groupBy("user_id", "_cell", "_band", "_col").agg(F.expr(_BOUNDING_BOX), *_first_of(_ORDER), *more)


def _numbered(clusters: DataFrame, key: str) -> DataFrame:
    """``cluster_label`` of each cluster: its place among the user's, by first stop."""
    return rank_in_time(clusters, "user_id", F.col(_FIRST[0]), [F.col(name) for name in (*_FIRST, key)],
                        "cluster_label").select("user_id", key, "cluster_label")


def recluster(history: DataFrame, new_stops: DataFrame, radius_m: float = CLUSTER_RADIUS_M,
              history_radius_m: float | None = CLUSTER_RADIUS_M) -> DataFrame:
    """Cluster stored stops and newly found ones together.

    Both durations are derived from the times where absent.  If ``history_radius_m``, the
    radius behind the stored labels, equals ``radius_m``, stored clusters are taken as they
    are: only cells within reach of new stops are compared, clusters that new stops connect
    become one, and labels are counted anew for the users concerned.  Otherwise (None, if
    unknown) everything is clustered again.  Stored stops without a label count as new.
    """
    names = [name for name in CLUSTERED_STOPS.fieldNames() if name != "cluster_label"]
    spans = [(name, F.col("t_end") - F.col("t_start")) for name in ("total_duration_stop_location", "duration")]

    def conform(df: DataFrame, *more: str) -> DataFrame:
        require_columns(df, *names, *more)
        extra = [F.coalesce(F.col(n), span).alias(n) if n in df.columns else span.alias(n) for n, span in spans]
        return df.select(*names, *extra, *more)

    if history_radius_m != radius_m:
        return cluster_stops(conform(history).unionByName(conform(new_stops)), radius_m)
    stored = conform(history, "cluster_label")
    unlabelled = F.col("cluster_label").isNull()
    fresh = cut_lineage(conform(new_stops).unionByName(stored.where(unlabelled).drop("cluster_label")))
    return _insert(stored.where(~unlabelled), fresh, _Grid(radius_m))


def _insert(stored: DataFrame, fresh: DataFrame, grid: "_Grid") -> DataFrame:
    """Put ``fresh`` stops into stored clusters, connecting those they bridge.

    A stored cell has one label, as its stops are connected.  The graph holds fresh cells and
    the stored cells they may reach; stored cells of one label are tied together, so each
    component is one cluster, made of any number of stored ones.
    """
    new = grid.assign(fresh)
    reach = grid.around(_cells_of(new)).distinct()
    old = grid.assign(stored).join(reach, ["user_id", "_cell"], "left_semi")
    celled = new.withColumn("_old", F.lit(None).cast("long")).unionByName(old.withColumnRenamed("cluster_label", "_old"))
    cells = cut_for_joins(_cells_of(celled, F.max("_old").alias("_old"), F.bool_or(F.col("_old").isNull()).alias("fresh")))
    labelled = cells.where(F.col("_old").isNotNull())
    anchors = labelled.groupBy("user_id", "_old").agg(F.min("_cell").alias("a"))
    ties = labelled.join(anchors, ["user_id", "_old"]).select("user_id", "a", F.col("_cell").alias("b")).where("a <> b")
    roots = _components(_touching_cells(celled, cells, grid).unionByName(ties))
    rooted = cut_lineage(cells.join(roots, ["user_id", "_cell"], "left").select(
        "user_id", "_cell", "_old", "fresh", F.coalesce("_root", "_cell").alias("_root")))
    # a cluster is named by its root, or by its label below zero if nothing new reaches it
    moved = rooted.where(F.col("_old").isNotNull()).select("user_id", F.col("_old").alias("cluster_label"), "_root").distinct()
    touched = fresh.select("user_id").distinct()
    firsts = (
        stored.join(touched, "user_id", "left_semi").groupBy("user_id", "cluster_label").agg(*_first_of(_ORDER))
        .join(moved, ["user_id", "cluster_label"], "left")
        .select("user_id", *_FIRST, F.coalesce("_root", -1 - F.col("cluster_label")).alias("_root"))
        .unionByName(new.join(rooted.where("fresh"), ["user_id", "_cell"]).groupBy("user_id", "_root").agg(*_first_of(_ORDER))))
    numbers = cut_lineage(_numbered(firsts.groupBy("user_id", "_root").agg(*_first_of()), "_root"))
    fresh_labels = rooted.where("fresh").join(numbers, ["user_id", "_root"]).select("user_id", "_cell", "cluster_label")
    kept = stored.columns[:-1]
    changed = numbers.where("_root < 0").select("user_id", (-1 - F.col("_root")).alias("_was"), "cluster_label").unionByName(
        moved.withColumnRenamed("cluster_label", "_was").join(numbers, ["user_id", "_root"]).select(
            "user_id", "_was", "cluster_label")).where("_was <> cluster_label").select(
        F.col("user_id").alias("_user"), "_was", F.col("cluster_label").alias("_now"))
    same = F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("cluster_label") == F.col("_was"))
    return stored.join(changed, same, "left").select(*kept, F.coalesce("_now", "cluster_label").alias("cluster_label")).unionByName(
        new.join(fresh_labels, ["user_id", "_cell"]).select(*kept, "cluster_label"))


def most_frequent_label(df: DataFrame, keys: list[str], label: str = "cluster_label") -> DataFrame:
    """The most frequent non-null ``label`` per key; ties go to the lowest."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("rank"), F.col(label).alias("label")))
    return counts.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.label").alias("most_frequent_label"))


class _Grid:
    """Latitude bands cut into columns; the diagonal of a cell stays below the radius.

    Each band has a whole number of columns around the globe, as wide as its
    equator-side edge allows, so the antimeridian is an ordinary column edge.
    """

    def __init__(self, radius_m: float) -> None:
        if radius_m <= 0.01:
            raise ValueError("radius_m must exceed 0.01")
        self.radius_m = radius_m
        self.height = math.degrees(radius_m / EARTH_RADIUS_M) / math.sqrt(2) * (1 - 1e-6)

    def columns_in(self, band: str) -> str:
        """Number of columns of a band, as SQL."""
        south, north = f"({band} * {self.height}D - 90)", f"(({band} + 1) * {self.height}D - 90)"
        equator_side = f"if({south} <= 0 and {north} >= 0, 0D, least(abs({south}), abs({north})))"
        return f"greatest(ceil(cos(radians({equator_side})) * 360D / {self.height}D), 1L)"

    def poleward_cos(self, band: str) -> str:
        edge = f"greatest(abs({band} * {self.height}D - 90), abs(({band} + 1) * {self.height}D - 90))"
        return f"cos(radians(least({edge}, 90D)))"

    def assign(self, points: DataFrame) -> DataFrame:
        """Add ``_band``, ``_col`` and ``_cell``, which packs the two."""
        return (
            points.selectExpr("*", f"floor((lat + 90) / {self.height}D) as _band")
            .selectExpr("*", f"{self.columns_in('_band')} as _cols")
            .selectExpr("*", "least(floor((lon + 180) / 360D * _cols), _cols - 1) as _col")
            .selectExpr("*", f"_band * {_CELL_STRIDE}L + _col as _cell")
        )

    def box(self, level: int) -> str:
        """A point's box after ``level`` cuts of its cell, as SQL; one box for level 0."""
        if not level:
            return "named_struct('y', -1L, 'x', -1L)"
        fine = SPLIT ** level
        return (f"named_struct('y', floor((lat + 90) / {self.height}D * {fine}L),"
                f" 'x', floor((lon + 180) / 360D * _cols * {fine}L))")

    def neighbours(self, cells: DataFrame) -> DataFrame:
        """Explode each cell to the cells its points may reach: ``_other``, each pair once.

        Looks at the cell's own band and the next two; bands and columns are limited to
        those within the radius of the points actually present.
        """
        return self._reached(cells, "array(_band, _band + 1, _band + 2)").where("_band2 > _band or _col2 > _col").selectExpr(
            *cells.columns, f"_band2 * {_CELL_STRIDE}L + _col2 as _other")

    def around(self, cells: DataFrame) -> DataFrame:
        """``user_id, _cell`` of all cells that points of ``cells`` may reach, their own among them."""
        bands = "array(_band - 2, _band - 1, _band, _band + 1, _band + 2)"
        return self._reached(cells, bands).selectExpr("user_id", f"_band2 * {_CELL_STRIDE}L + _col2 as _cell")

    def _reached(self, cells: DataFrame, bands: str) -> DataFrame:
        half = math.sin(self.radius_m / (2 * EARTH_RADIUS_M))
        far = f"{math.degrees(self.radius_m / EARTH_RADIUS_M) + 1e-9}D"
        return (
            cells.selectExpr("*", f"explode({bands}) as _band2")
            .where(f"_band2 * {self.height}D - 90 - box.north <= {far} and box.south - ((_band2 + 1) * {self.height}D - 90) <= {far}")
            .selectExpr("*", f"{self.columns_in('_band2')} as _cols2",
                        f"sqrt({self.poleward_cos('_band')} * {self.poleward_cos('_band2')}) as _shrink")
            .selectExpr("*", f"if(_shrink > {half}D, degrees(2 * asin({half}D / _shrink)) + 1e-9D, 360D) as _reach")
            .selectExpr("*", "floor((box.west + 180 - _reach) / 360D * _cols2) as _low",
                        "floor((box.east + 180 + _reach) / 360D * _cols2) as _high")
            .selectExpr("*", "explode(if(_high - _low + 1 >= _cols2, sequence(0L, _cols2 - 1),"
                             " transform(sequence(_low, _high), c -> pmod(c, _cols2)))) as _col2")
        )


_BOUNDING_BOX = "named_struct('south', min(lat), 'north', max(lat), 'west', min(lon), 'east', max(lon)) as box"


def _judge(pairs: DataFrame, radius_m: float) -> DataFrame:
    """Replace the boxes ``p`` and ``q`` by a verdict.

    'near' if some stops of the boxes are surely in reach, 'open' if undecided; pairs
    with surely none are dropped.
    """

    def equator_cos(box: str) -> str:
        return (f"if({box}.south <= 0 and {box}.north >= 0, 1D,"
                f" cos(radians(least(abs({box}.south), abs({box}.north)))))")

    def poleward_cos(box: str) -> str:
        return f"cos(radians(greatest(abs({box}.south), abs({box}.north))))"

    def arc(lat: str, lon: str, shrink: str) -> str:
        return (f"{2 * EARTH_RADIUS_M}D * asin(sqrt(least(1D, pow(sin(radians({lat}) / 2), 2)"
                f" + {shrink} * pow(sin(radians({lon}) / 2), 2))))")

    measured = (
        pairs.selectExpr(
            "*",
            "greatest(0D, q.south - p.north, p.south - q.north) as _lat_gap",
            "greatest(p.north, q.north) - least(p.south, q.south) as _lat_span",
            "abs(pmod((q.west + q.east - p.west - p.east) / 2 + 180D, 360D) - 180D) as _between",
            "(p.east - p.west + q.east - q.west) / 2 as _width",
            f"{poleward_cos('p')} * {poleward_cos('q')} as _cos_low",
            f"{equator_cos('p')} * {equator_cos('q')} as _cos_high",
            "p.south = p.north and p.west = p.east and q.south = q.north and q.west = q.east as _single",
        )
        .selectExpr(
            "*",
            f"{arc('_lat_gap', 'greatest(0D, _between - _width)', '_cos_low')} as _nearest",
            f"{arc('_lat_span', 'least(180D, _between + _width)', '_cos_high')} as _farthest",
        )
        .withColumn("_exact", haversine_m(F.col("p.south"), F.col("p.west"), F.col("q.south"), F.col("q.west")))
    )
    verdict = (
        f"case when _single then if(_exact <= {radius_m}D, 'near', 'far')"
        f" when _farthest <= {radius_m - TOLERANCE_M}D then 'near'"
        f" when _nearest > {radius_m + TOLERANCE_M}D then 'far' else 'open' end as verdict"
    )
    kept = [c for c in pairs.columns if c not in ("p", "q")]
    return measured.selectExpr(*kept, verdict).where("verdict <> 'far'")


def _touching_cells(celled: DataFrame, cells: DataFrame, grid: _Grid) -> DataFrame:
    """Pairs of cells (``a``, ``b``) that hold two stops within the radius.

    If cells tell whether they are ``fresh``, one of a pair must be.  Cells are compared by the bounding boxes of their stops.  Where the boxes leave it
    open, the pair is looked at again with each box cut into smaller ones, until every
    pair is decided.  A pair never meets stop by stop, however many stops it has; boxes
    of a single location are compared exactly.
    """
    fresh = "fresh" if "fresh" in cells.columns else "true"
    pairs = grid.neighbours(cells).selectExpr("user_id", "_cell as a", "_other as b", "box as p", f"{fresh} as p_fresh").join(
        cells.selectExpr("user_id", "_cell as b", "box as q", f"{fresh} as q_fresh"), ["user_id", "b"]).where(
        "p_fresh or q_fresh").drop("p_fresh", "q_fresh")
    judged = cut_lineage(_judge(pairs, grid.radius_m))
    near = [judged.where("verdict = 'near'").select("user_id", "a", "b")]
    pending = judged.where("verdict = 'open'").selectExpr(
        "user_id", "a", "b", f"{grid.box(0)} as box_a", f"{grid.box(0)} as box_b")
    level = 0
    while not pending.isEmpty():
        level += 1
        judged = cut_lineage(_judge_smaller(celled, pending, grid, level))
        found = judged.where("verdict = 'near'").select("user_id", "a", "b").distinct()
        near.append(found)
        pending = (
            judged.where("verdict = 'open'").drop("verdict").join(found, ["user_id", "a", "b"], "left_anti")
        )
    return reduce(DataFrame.unionByName, near)


def _judge_smaller(celled: DataFrame, pending: DataFrame, grid: _Grid, level: int) -> DataFrame:
    """Judge the boxes one cut finer inside each pending pair of boxes."""
    wanted = pending.selectExpr("user_id", "a as _cell", "box_a as _outer").unionByName(
        pending.selectExpr("user_id", "b as _cell", "box_b as _outer")).distinct()
    boxes = (
        celled.selectExpr("user_id", "_cell", "lat", "lon", f"{grid.box(level - 1)} as _outer",
                          f"{grid.box(level)} as _inner")
        .join(wanted, ["user_id", "_cell", "_outer"], "left_semi")
        .groupBy("user_id", "_cell", "_outer", "_inner").agg(F.expr(_BOUNDING_BOX))
    )
    side_a = boxes.selectExpr("user_id", "_cell as a", "_outer as box_a", "_inner as inner_a", "box as p")
    side_b = boxes.selectExpr("user_id", "_cell as b", "_outer as box_b", "_inner as inner_b", "box as q")
    pairs = pending.join(side_a, ["user_id", "a", "box_a"]).join(side_b, ["user_id", "b", "box_b"])
    return _judge(pairs.selectExpr("user_id", "a", "b", "inner_a as box_a", "inner_b as box_b", "p", "q"),
                  grid.radius_m)


def _components(edges: DataFrame) -> DataFrame:
    """Connected components: ``_cell`` and the lowest cell ``_root`` of its component.

    Cells that touch no other cell do not appear.  Within a region of a user the touching
    cells are followed in one pass, which leaves one root per component there.  Only
    where an edge crosses to another region, roots are connected further, by joins.
    """
    placed = edges.select("user_id", "a", "b", _region("a").alias("region"), _region("b").alias("other"))
    inside = placed.where("region = other").select("user_id", "region", "a", "b")
    local = inside.repartition("user_id", "region").sortWithinPartitions("user_id", "region").mapInArrow(
        follow_edges, "user_id string, _cell long, _root long")
    across = placed.where("region <> other").select("user_id", "a", "b")
    if across.isEmpty():
        return local
    across = cut_lineage(across)
    ends = across.select("user_id", F.col("a").alias("_cell")).union(across.select("user_id", "b")).distinct()
    local = cut_lineage(local)
    local = cut_lineage(local.unionByName(
        ends.join(local, ["user_id", "_cell"], "left_anti").withColumn("_root", F.col("_cell"))))
    for side in ("a", "b"):
        across = across.join(local.withColumnsRenamed({"_cell": side, "_root": f"{side}_root"}), ["user_id", side])
    joined = _star_components(across.select("user_id", F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    joined = joined.select("user_id", F.col("_root").alias("_last"), F.col("_cell").alias("_root"))
    return local.join(joined, ["user_id", "_root"], "left").select(
        "user_id", "_cell", F.coalesce("_last", "_root").alias("_root"))


def _region(cell: str) -> Column:
    return F.expr(f"{cell} div {_CELL_STRIDE}L div {REGION} * {_CELL_STRIDE}L + {cell} % {_CELL_STRIDE}L div {REGION}")


def follow_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of one user's region after another, from pairs sorted by user and region."""
    group: tuple[str | None, int | None] = None, None
    parent: dict[int, int] = {}

    def top(cell: int) -> int:
        while parent[cell] != cell:
            parent[cell] = cell = parent[parent[cell]]
        return cell

    def result() -> pa.RecordBatch:
        cells = list(parent)
        return pa.RecordBatch.from_pydict(
            {"user_id": [group[0]] * len(cells), "_cell": cells, "_root": [top(cell) for cell in cells]},
            schema=pa.schema([("user_id", pa.string()), ("_cell", pa.int64()), ("_root", pa.int64())]))

    for batch in batches:
        for user, region, a, b in zip(*(column.to_pylist() for column in batch.columns)):
            if (user, region) != group:
                if parent:
                    yield result()
                group = user, region
                parent.clear()
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    if parent:
        yield result()


def _star_components(edges: DataFrame) -> DataFrame:
    """Components by alternating large-star and small-star steps.

    The method is that of Kiveris et al., "Connected Components in MapReduce and Beyond"
    (2014); it needs a logarithmic number of rounds in practice.
    """
    edges = cut_lineage(edges.distinct())
    before = _fingerprint(edges)
    while before[0]:
        edges = cut_lineage(_star(_star(edges, large=True), large=False))
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.select("user_id", F.greatest("a", "b").alias("_cell"), F.least("a", "b").alias("_root"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each cell's neighbours (larger ones, or it and its smaller ones) on the lowest of them."""
    ordered = edges.select("user_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if large:
        ordered = ordered.unionByName(ordered.select("user_id", F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = ordered.groupBy("user_id", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = ordered.join(lowest, ["user_id", "a"])
    if large:
        hung = linked.where("b > a").select("user_id", F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = linked.select("user_id", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select("user_id", "a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("user_id", F.greatest("a", "b"), F.least("a", "b")))).first()
    return tuple(row)
