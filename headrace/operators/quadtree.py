"""Polygons as a quadtree of their edges: point in polygon and exact intersection of layers.

Cells are split by the number of edges in them. Each cell knows whether its centre lies inside; a point is
compared with its own cell's edges only, along a path from the centre, and with none in a cell without
edges. A path runs vertically, then horizontally, and both parts read the side of their corner from one
formula, so that rounding cannot make them disagree. Points on an outline count as if moved right and,
by less, up.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headrace.session import reliable_checkpoint

#: Edges of a cell that is not split, and the deepest split (edges that share a point can't be parted).
LEAF_EDGES, MAX_LEVEL = 32, 24
#: Widening of cells when edges are dealt to them, as a share of the cell: more edges do no harm, fewer would.
SLACK = 1e-6
ENDS = ("x1", "y1", "x2", "y2")


class EdgeCells(NamedTuple):
    """``leaves``: (poly, level, cx, cy, inside, edges); ``edges`` is NULL in a cell wholly inside."""

    leaves: DataFrame
    levels: int
    cell: float


def _side(x: Column, y: Column, e=F.col) -> Column:
    """Above zero if (x, y) is left of the edge that runs from (x1, y1) to (x2, y2)."""
    x1, y1, x2, y2 = (e(c) for c in ENDS)
    return (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)


def _west(x: Column, y: Column, e=F.col) -> Column:
    """The edge, which spans y, passes east of (x, y)."""
    side = _side(x, y, e)
    return F.when(e("y2") > e("y1"), side > 0).otherwise(side < 0)


def _below(x: Column, y: Column, e=F.col) -> Column:
    """The edge, which spans x, passes above (x, y). A point on a rising edge is right of it, hence below."""
    side, east, rising = _side(x, y, e), e("x2") > e("x1"), (e("x2") > e("x1")) == (e("y2") > e("y1"))
    level = e("y1") == e("y2")
    return F.when(side == 0, rising & ~level).when(east, side < 0).otherwise(side > 0)


def _crosses(ax: Column, ay: Column, bx: Column, by: Column, e=F.col) -> Column:
    """Whether the path (ax, ay) - (ax, by) - (bx, by) meets the edge once, not never or twice."""
    up = ((e("x1") > ax) != (e("x2") > ax)) & (_below(ax, ay, e) != _below(ax, by, e))
    along = ((e("y1") > by) != (e("y2") > by)) & (_west(ax, by, e) != _west(bx, by, e))
    return up != along


def _meets_box(xa: Column, xb: Column, ya: Column, yb: Column) -> Column:
    """The edge may touch the box: its y-range over the common x-range meets the box's."""
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    slope = F.try_divide(y2 - y1, x2 - x1)
    left, right = F.greatest(F.least(x1, x2), xa), F.least(F.greatest(x1, x2), xb)
    at_left, at_right = F.coalesce(y1 + (left - x1) * slope, y1), F.coalesce(y1 + (right - x1) * slope, y2)
    return (left <= right) & (F.least(at_left, at_right) <= yb) & (F.greatest(at_left, at_right) >= ya) & (
        F.least(y1, y2) <= yb) & (F.greatest(y1, y2) >= ya)


def _in_cell(size: Column) -> Column:
    pad = size * SLACK
    return _meets_box(F.col("cx") * size - pad, (F.col("cx") + 1) * size + pad, F.col("cy") * size - pad, (F.col("cy") + 1) * size + pad)


def _sequence(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo), F.floor(hi)))


def crossed_cells(segments: DataFrame, size: float) -> DataFrame:
    """``segments`` with a row for each cell (cx, cy) that they touch, column by column of the grid."""
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    slope = F.try_divide(y2 - y1, x2 - x1)
    pad = size * SLACK
    at = segments.select("*", _sequence((F.least(x1, x2) - pad) / size, (F.greatest(x1, x2) + pad) / size).alias("cx"))
    left = F.greatest(F.least(x1, x2), F.col("cx") * size - pad)
    right = F.least(F.greatest(x1, x2), (F.col("cx") + 1) * size + pad)
    a, b = F.coalesce(y1 + (left - x1) * slope, y1), F.coalesce(y1 + (right - x1) * slope, y2)
    lo, hi = F.greatest(F.least(a, b), F.least(y1, y2)), F.least(F.greatest(a, b), F.greatest(y1, y2))
    return at.withColumn("__lo", lo - pad).withColumn("__hi", F.greatest(lo, hi) + pad).select(
        *segments.columns, "cx", _sequence(F.col("__lo") / size, F.col("__hi") / size).alias("cy"))


def _first_cells(edges: DataFrame, poly: str, size: float) -> DataFrame:
    """(poly, cx, cy, inside): grid cells whose centre is inside, or which hold edges, by a scan line through each row's centres.

    A crossing counts for the centres west of it; only in its own cell is the side computed.
    """
    half = F.lit(size / 2)
    at_y = F.col("cy") * size + half
    y1, y2 = F.col("y1"), F.col("y2")
    rows = edges.select(poly, *ENDS, _sequence(F.least(y1, y2) / size - 1, F.greatest(y1, y2) / size + 1).alias("cy")).filter((y1 > at_y) != (y2 > at_y))
    at_x = F.col("x1") + (at_y - y1) * (F.col("x2") - F.col("x1")) / (y2 - y1)
    met = rows.select("*", F.floor(at_x / size).alias("cx"))
    west = _west(F.col("cx") * size + half, at_y)
    # the crossing toggles the centres of all cells up to ``last``
    toggles = met.select(poly, "cy", (F.col("cx") - F.when(west, 0).otherwise(1)).alias("last")).groupBy(poly, "cy", "last").agg(
        (F.count(F.lit(1)) % 2).alias("odd")).filter("odd = 1")
    row = Window.partitionBy(poly, "cy").orderBy("last")  # cells of one row at most
    runs = toggles.select(poly, "cy", "last", F.lag("last").over(row).alias("before"), F.row_number().over(row).alias("i"))
    inside = runs.filter("i % 2 = 0").select(poly, F.explode(F.sequence(F.col("before") + 1, F.col("last"))).alias("cx"), "cy", F.lit(True).alias("inside"))
    held = crossed_cells(edges.select(poly, *ENDS), size).select(poly, "cx", "cy").distinct()
    return held.join(inside, [poly, "cx", "cy"], "full_outer").select(poly, "cx", "cy", F.coalesce("inside", F.lit(False)).alias("inside"))


def edge_cells(edges: DataFrame, poly: str = "poly", cell: float = 1.0, leaf_edges: int = LEAF_EDGES) -> EdgeCells:
    """The quadtree's leaves, without cells that are outside and hold no edges.

    ``edges``: poly, x1, y1, x2, y2, outlines closed (``polygon_edges``). A round per level; each spreads the
    edges of the cells that are still too full.
    """
    edges = edges.select(poly, *ENDS).filter("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    key = [poly, "cx", "cy"]
    cells = _first_cells(edges, poly, cell)
    held = crossed_cells(edges, cell)
    leaves = None
    for level in range(MAX_LEVEL + 1):
        size = cell / 2**level
        held = reliable_checkpoint(held)
        counts = held.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        full = reliable_checkpoint(counts.filter((F.col("n") > leaf_edges) & F.lit(level < MAX_LEVEL)).select(*key))
        last = full.limit(1).count() == 0
        if not last:
            cells = reliable_checkpoint(cells)
        rest, left = (cells, held) if last else (cells.join(full, key, "left_anti"), held.join(full, key, "left_anti"))
        packed = left.groupBy(*key).agg(F.collect_list(F.struct(*ENDS)).alias("edges"))  # leaf_edges at most, but for shared points
        whole = rest.join(packed, key, "left").filter("inside OR edges IS NOT NULL").select(
            poly, F.lit(level).alias("level"), "cx", "cy", "inside", "edges")
        leaves = whole if leaves is None else leaves.unionByName(whole)
        if last:
            return EdgeCells(leaves, level + 1, cell)
        split = cells.join(full, key, "left_semi")
        # edges of full cells against the four quarters; a quarter's centre is reached from the cell's
        quarters = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (0, 1) for j in (0, 1)])).alias("q")
        spread = held.join(split, key).select(poly, *ENDS, "inside", F.col("cx").alias("px"), F.col("cy").alias("py"), quarters).select(
            poly, *ENDS, "inside", "px", "py", (2 * F.col("px") + F.col("q.dx")).alias("cx"), (2 * F.col("py") + F.col("q.dy")).alias("cy"))
        half = size / 2
        path = _crosses((F.col("px") + 0.5) * size, (F.col("py") + 0.5) * size, (F.col("cx") + 0.5) * half, (F.col("cy") + 0.5) * half)
        spread = spread.withColumn("crossed", path)
        cells = spread.groupBy(*key).agg((F.first("inside") != (F.count_if(F.col("crossed")) % 2 == 1)).alias("inside"))
        held = spread.filter(_in_cell(F.lit(half))).select(*key, *ENDS)
    raise AssertionError("the last level is never split")


def holding(points: DataFrame, cells: EdgeCells, poly: str = "poly", x: str = "lon", y: str = "lat") -> DataFrame:
    """(x, y, poly) for each distinct position and polygon that holds it. One join of the points with the leaves."""
    spots = points.select(F.col(x).alias("px"), F.col(y).alias("py")).filter("px IS NOT NULL AND py IS NOT NULL").distinct()
    cell = cells.cell

    def place(level: int) -> Column:
        size = cell / 2**level
        return F.struct(F.lit(level).alias("level"), F.floor(F.col("px") / size).alias("cx"), F.floor(F.col("py") / size).alias("cy"))

    at = spots.select("px", "py", F.explode(F.array(*[place(v) for v in range(cells.levels)])).alias("c")).select("px", "py", "c.*")
    met = at.join(cells.leaves, ["level", "cx", "cy"])
    size = F.pow(F.lit(2.0), -F.col("level")) * cell
    cx, cy = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
    crossed = F.aggregate(F.coalesce("edges", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")), F.lit(False),
                          lambda odd, e: odd != _crosses(cx, cy, F.col("px"), F.col("py"), e.getField))
    return met.filter(F.col("inside") != crossed).select(F.col("px").alias(x), F.col("py").alias(y), poly)


def _touching(a, b) -> Column:
    """Segments a and b (functions from end names to columns) share a point; ends and collinear overlaps count."""
    def apart(p, q):  # both ends of q strictly on one side of p
        s, t = _side(q("x1"), q("y1"), p), _side(q("x2"), q("y2"), p)
        return ((s > 0) & (t > 0)) | ((s < 0) & (t < 0))

    boxes = F.lit(True)
    for lo, hi in (("x1", "x2"), ("y1", "y2")):
        boxes = boxes & (F.least(a(lo), a(hi)) <= F.greatest(b(lo), b(hi))) & (F.least(b(lo), b(hi)) <= F.greatest(a(lo), a(hi)))
    return boxes & ~apart(a, b) & ~apart(b, a)


def intersecting(segments: DataFrame, area: DataFrame, feature: str, cell: float = 0.1) -> DataFrame:
    """J-22: features that share a point with the study area, by exact tests.

    ``segments``: feature, x1, y1, x2, y2 and ``closed`` (the feature is a surface with these outlines); a point is
    a segment of no length. ``area``: poly, x1, y1, x2, y2, closed outlines with holes by the even-odd rule.
    Segments meet the area's edges in the grid cells that both cross. A feature that crosses no edge lies wholly
    inside or outside, which one end of each segment tells, or it is a surface around the area.
    """
    segments = reliable_checkpoint(segments.select(feature, *ENDS, "closed"))
    area = reliable_checkpoint(area.select("poly", *ENDS))
    rim = crossed_cells(area.select(*[F.col(c).alias(f"a_{c}") for c in ENDS], *ENDS), cell).select("cx", "cy", *[f"a_{c}" for c in ENDS])
    mine = crossed_cells(segments, cell).select(feature, *ENDS, "cx", "cy")
    met = mine.join(rim, ["cx", "cy"]).filter(_touching(F.col, lambda c: F.col(f"a_{c}"))).select(feature).distinct()
    met = reliable_checkpoint(met)
    rest = reliable_checkpoint(segments.join(met, feature, "left_anti"))
    starts = rest.select(feature, F.col("x1").alias("lon"), F.col("y1").alias("lat"))
    size = 4 * cell
    inner = starts.join(holding(starts, edge_cells(area, "poly", size)).select("lon", "lat").distinct(), ["lon", "lat"]).select(feature)
    # surfaces around the area: one corner of each of its outlines' edges is inside them
    corners = area.select(F.col("x1").alias("lon"), F.col("y1").alias("lat"))
    around = holding(corners, edge_cells(rest.filter("closed"), feature, size), feature).select(feature)
    return met.unionByName(inner).unionByName(around).distinct()
