"""Rings as cells of a quadtree: a cell within a ring needs no test, one at its border only the edges that touch it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions import geo
from dispatchlake.scratch import cut

#: where the cells begin: an odd place, so that no corner of a ring lies on a border between cells
WEST, SOUTH = -1000.00718281, -1000.00314159
#: edges that a cell may have without being cut in four, and how often a cell is cut at most
FEW, DEPTH = 8, 12


def _cell(v: Column, level: Column, start: float) -> Column:
    """The cell of a coordinate; cells of a level have sides of 2 ** -level degrees."""
    return F.floor((v - start) * F.pow(F.lit(2.0), level))


def _box() -> tuple[Column, Column, Column, Column]:
    side = F.pow(F.lit(2.0), -F.col("level"))
    west, south = F.lit(WEST) + F.col("cx") * side, F.lit(SOUTH) + F.col("cy") * side
    return west, south, west + side, south + side


def _touches(e: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Whether an edge may meet a box; one that misses it by a hair counts too."""
    west, south, east, north = box
    hair = F.lit(1e-9)
    west, south, east, north = west - hair, south - hair, east + hair, north + hair
    sides = [(e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]) for x in (west, east) for y in (south, north)]
    near = (F.greatest(e["ax"], e["bx"]) >= west) & (F.least(e["ax"], e["bx"]) <= east) & (F.greatest(e["ay"], e["by"]) >= south) & (F.least(e["ay"], e["by"]) <= north)
    return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _within(x: Column, y: Column) -> Column:
    """Whether a point of a cell is in the ring: `corner` says it of the cell's south-east corner, and edges are crossed on the way up and then west."""
    _, south, east, _ = _box()

    def crossed(inside: Column, e: Column) -> Column:
        up = F.try_divide((e["by"] - e["ay"]) * (east - e["ax"]), e["bx"] - e["ax"]) + e["ay"]
        at = F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]
        north = ((e["ax"] > east) != (e["bx"] > east)) & F.coalesce((up > south) & (up <= y), F.lit(False))
        west = ((e["ay"] > y) != (e["by"] > y)) & F.coalesce((x < at) != (east < at), F.lit(False))
        return (inside != north) != west

    return F.aggregate("edges", F.col("corner"), crossed)


def _begun(areas: DataFrame) -> DataFrame:
    """Each ring in the one to four cells that are as wide as it is."""
    of = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    known = F.forall("ring", lambda p: F.coalesce(p["x"].isNotNull() & p["y"].isNotNull(), F.lit(False)))
    rings = areas.select("ord", "name", F.explode("rings").alias("ring")).where((F.size("ring") > 2) & known)
    spans = {"w": of(F.array_min, "x"), "e": of(F.array_max, "x"), "s": of(F.array_min, "y"), "n": of(F.array_max, "y")}
    rings = rings.withColumns(spans).withColumn("level", -F.ceil(F.log2(F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"), F.lit(1e-6)))).cast("int"))
    cells = lambda low, high, start: F.explode(F.sequence(_cell(F.col(low), F.col("level"), start), _cell(F.col(high), F.col("level"), start)))
    rings = rings.withColumn("cx", cells("w", "e", WEST)).withColumn("cy", cells("s", "n", SOUTH))

    def edge(i: Column) -> Column:
        a, b = F.element_at("ring", i), F.element_at("ring", F.when(i == 1, -1).otherwise(i - 1))
        return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))

    box = _box()
    edges = F.filter(F.transform(F.sequence(F.lit(1), F.size("ring")), edge), lambda e: _touches(e, box))
    return rings.select("ord", "name", "level", "cx", "cy", geo.in_ring(box[2], box[1], F.col("ring")).alias("corner"), edges.alias("edges"))


def _quartered(cells: DataFrame) -> DataFrame:
    quarter = F.explode(F.array(*[F.struct((F.col("cx") * 2 + x).alias("x"), (F.col("cy") * 2 + y).alias("y")) for x in (0, 1) for y in (0, 1)]))
    whole = cells.select("*", quarter.alias("q"))
    side = F.pow(F.lit(2.0), -(F.col("level") + 1))
    corner = _within(F.lit(WEST) + (F.col("q.x") + 1) * side, F.lit(SOUTH) + F.col("q.y") * side)
    # the corner is told in the whole cell's terms, so before its columns are renewed
    parts = whole.withColumn("corner", corner).select("ord", "name", (F.col("level") + 1).alias("level"), F.col("q.x").alias("cx"), F.col("q.y").alias("cy"), "corner", "edges")
    return parts.withColumn("edges", F.filter("edges", lambda e: _touches(e, _box())))


def cover(areas: DataFrame, few: int = FEW, depth: int = DEPTH) -> DataFrame:
    """(ord, name, level, cx, cy, corner, edges): the cells that rings lie in, each point of a ring in one cell of it.

    areas: ord, name, rings (array of rings, each an array of struct(x, y)). A cell with more than `few` edges is cut
    in four, `depth` times at most; cells without edges that lie outside go. Rings of fewer than three points, or
    with a missing coordinate, hold nothing.
    """
    done, cells = [], cut(_begun(areas), "cells")
    for step in range(depth + 1):
        whole = (F.size("edges") <= few) | F.lit(step == depth)
        done.append(cells.where(whole & ((F.size("edges") > 0) | F.col("corner"))))
        cells = cells.where(~whole)
        if step == depth or cells.isEmpty():
            break
        cells = cut(_quartered(cells), "cells")
    return reduce(DataFrame.unionByName, done)


def held(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs of a point (lat, lng and more) and an area (ord, name) whose ring holds it, by an equi-join of cells; once for each such ring.

    A point goes to its cell of each level there is, so its copies depend on the sizes of cells, not on their number.
    """
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())  # a few dozen sizes at most
    if not levels:
        return points.crossJoin(cells.select("ord", "name").limit(0))
    level = F.explode(F.array(*map(F.lit, levels))).alias("level")
    laid = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("*", level)
    laid = laid.withColumns({"cx": _cell(F.col("lng"), F.col("level"), WEST), "cy": _cell(F.col("lat"), F.col("level"), SOUTH)})
    return laid.join(cells, ["level", "cx", "cy"]).where(_within(F.col("lng"), F.col("lat"))).drop("level", "cx", "cy", "corner", "edges")
