"""Positions stored along a curve, so that a box reads few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.operators.filters import in_box

BITS = 16  # of each axis in a cell number
RANGES = 32  # of cells that a box is searched by, at most
CELL = "cell"


def _axis(value: Column, low: float, high: float) -> Column:
    """The 2^BITS parts of an axis by number; values beyond its ends belong to the outer ones."""
    share = (value.cast("double") - F.lit(low)) / F.lit(high - low)
    part = F.floor(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * F.lit(float(1 << BITS)))
    return F.least(part, F.lit((1 << BITS) - 1)).cast("long")


def _spread(x: Column) -> Column:
    """A zero between each two of 16 bits."""
    for step, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, step)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def cell_of(lon: Column | str, lat: Column | str) -> Column:
    """Morton number of the cell in which a position lies: the bits of both axes in turn.

    Null without a position. NaN counts as the highest value, as in Spark's comparisons.
    """
    lon = F.col(lon) if isinstance(lon, str) else lon
    lat = F.col(lat) if isinstance(lat, str) else lat
    x, y = _axis(lon, -180.0, 180.0), _axis(lat, -90.0, 90.0)
    code = _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))
    return F.when(lon.isNotNull() & lat.isNotNull(), code)


def _part(value: float, low: float, high: float) -> int:
    share = min(max((value - low) / (high - low), 0.0), 1.0)
    return min(int(share * (1 << BITS)), (1 << BITS) - 1)


def box_ranges(west: float, south: float, east: float, north: float, most: int = RANGES
               ) -> list[tuple[int, int]]:
    """Ranges (first, last) of cell numbers that hold every cell of a box, at most ``most``.

    Squares of the curve are halved twice as long as they lie partly in the box and there are
    ranges left; those that still do then are taken whole, so the exact test decides.
    """
    if not (west <= east and south <= north):
        return []
    x0, x1 = _part(west, -180.0, 180.0), _part(east, -180.0, 180.0)
    y0, y1 = _part(south, -90.0, 90.0), _part(north, -90.0, 90.0)
    done: list[tuple[int, int]] = []
    open_squares = [(0, 0, BITS)]  # number of the square in its level, x and y follow from it
    while open_squares:
        level = []
        for code, _, size in open_squares:
            x = sum((code >> 2 * i & 1) << i for i in range(BITS)) << size
            y = sum((code >> 2 * i + 1 & 1) << i for i in range(BITS)) << size
            x2, y2 = x + (1 << size) - 1, y + (1 << size) - 1
            if x > x1 or x2 < x0 or y > y1 or y2 < y0:
                continue
            if x >= x0 and x2 <= x1 and y >= y0 and y2 <= y1:
                done.append((code << 2 * size, (code + 1 << 2 * size) - 1))
            else:
                level.append((code, 0, size))
        # Halving makes up to four of one; neighbours join again below.
        if not level or level[0][2] == 0 or len(_merged(done)) + 4 * len(level) > most:
            done += [(c << 2 * s, (c + 1 << 2 * s) - 1) for c, _, s in level]
            break
        open_squares = [(4 * c + k, 0, s - 1) for c, _, s in level for k in range(4)]
    return _merged(done)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def write_placed(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat", **options) -> None:
    """Store positions with their cell, in the order of cells, so row groups hold near ones.

    Rows are dealt out by ranges of cells; a hot cell may fill a file by itself. ``options`` are
    those of the Parquet writer.
    """
    placed = df.withColumn(CELL, cell_of(lon, lat))
    placed.repartitionByRange(CELL).sortWithinPartitions(CELL).write.mode("append").options(
        **options).parquet(path)


def by_box(df: DataFrame, west: float, south: float, east: float, north: float,
           lon: str = "lon", lat: str = "lat", most: int = RANGES) -> DataFrame:
    """``in_box`` on a store of ``write_placed``: the box's ranges of cells skip row groups, and
    the exact test follows. Edges are in; rows without a position aren't."""
    found = F.lit(False)
    for first, last in box_ranges(west, south, east, north, most):
        found = found | F.col(CELL).between(F.lit(first), F.lit(last))
    return df.where(found & in_box(lon, lat, west, south, east, north))
