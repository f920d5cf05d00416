"""Rasters as sparse cell tables: surface and terrain models, colours, footprints and measurements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightspark.functions import geodesy
from flightspark.operators.scale import attach, dealt, exact_quantiles, shuffled
from flightspark.session import checkpointed

FLIGHT = "flight_id"
CELL = [FLIGHT, "row", "col"]


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets (row, column) of a filled ellipse in a size x size box."""
    r = size // 2
    out = []
    for dy in range(-r, r + 1):
        half = int(round(r * math.sqrt(max(0.0, r * r - dy * dy) / (r * r)))) if r else 0
        out += [(dy, dx) for dx in range(-half, half + 1)]
    return out


def raster_grid(vertices: DataFrame, gsd: float, lo: int = 32, hi: int | None = None) -> DataFrame:
    """Extent, size and true ground sample distance of each flight's raster; `hi` bounds the cells of a side if given.

    A raster is a table of its filled cells, so a large site costs rows only where it has some.
    """
    b = vertices.groupBy(FLIGHT).agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    for c in "xy":
        b = b.withColumn("span_" + c, F.greatest(F.lit(1.0), F.col(f"{c}_max") - F.col(f"{c}_min")))
    whole = lambda c: F.greatest(F.lit(lo), F.ceil(F.col("span_" + c) / gsd))
    size = lambda c: (whole(c) if hi is None else F.least(F.lit(hi), whole(c))).cast("long")
    b = b.withColumns({"width": size("x"), "height": size("y")})
    return b.withColumns({"gsd_x": F.col("span_x") / F.col("width"), "gsd_y": F.col("span_y") / F.col("height")})


def dsm_ortho(vertices: DataFrame, grid: DataFrame) -> DataFrame:
    """Highest vertex of every cell with its colour (row counted from the top); the larger vid wins a tie."""
    d = attach(vertices, grid.select(FLIGHT, "x_min", "y_max", "gsd_x", "gsd_y", "width", "height"), FLIGHT, "inner")
    at = lambda v, n: F.least(n - 1, F.greatest(F.lit(0), F.floor(v)))
    d = d.withColumns({"row": at((F.col("y_max") - F.col("y")) / F.col("gsd_y"), F.col("height")), "col": at((F.col("x") - F.col("x_min")) / F.col("gsd_x"), F.col("width"))})
    top = F.max_by(F.struct("z", "r", "g", "b"), F.struct("z", "vid"))
    return d.groupBy(*CELL).agg(top.alias("_t")).select(*CELL, "_t.*")


def _tiled(cells: DataFrame, rows: int) -> DataFrame:
    """Cells dealt out by tiles of 64 x 64, so that copies of neighbours meet in the task that makes them and are merged there."""
    tile = [F.floor(F.col(c) / 64) for c in ("row", "col")]
    return dealt(cells, rows, FLIGHT, *tile, size=1 << 16)


def _on_raster(size: int) -> Column:
    """How many cells of the ellipse around a cell lie on the raster. A row of an ellipse is one run, so its ends tell."""
    runs = {}
    for dy, dx in ellipse(size):
        runs[dy] = max(runs.get(dy, 0), dx)
    row, col, width = F.col("row"), F.col("col"), F.col("width")
    inside = lambda half: F.greatest(F.lit(0), F.least(width - 1, col + half) - F.greatest(F.lit(0), col - half) + 1)
    return sum((F.when((row + dy).between(0, F.col("height") - 1), inside(half)).otherwise(0) for dy, half in runs.items()), F.lit(0))


def _offsets(cells: DataFrame, size: int) -> DataFrame:
    """Every cell copied to the cells its ellipse covers."""
    kernel = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ellipse(size)])
    return cells.withColumn("_o", F.explode(kernel)).withColumns({"row": F.col("row") + F.col("_o.dy"), "col": F.col("col") + F.col("_o.dx")}).drop("_o")


def _inside(cells: DataFrame, grid: DataFrame) -> DataFrame:
    return attach(cells, grid.select(FLIGHT, "width", "height"), FLIGHT, "inner", compute_once=False).filter(
        F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1)).drop("width", "height")


def close_mask(cells: DataFrame, grid: DataFrame, size: int = 5) -> DataFrame:
    """Cells of the closed mask. Dilation marks cells near the mask; a cell stays when all cells of its ellipse that lie
    on the raster are marked (cells off the raster do not count against it)."""
    grid = checkpointed(grid.select(FLIGHT, "width", "height"))
    cells = checkpointed(cells.select(*CELL))
    grown = checkpointed(_inside(_offsets(_tiled(cells, cells.count()), size).distinct(), grid))
    votes = _inside(_offsets(_tiled(grown, grown.count()), size), grid).groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"))
    d = attach(votes, grid, FLIGHT, "inner", compute_once=False)
    return d.filter(F.col("_n") == _on_raster(size)).select(*CELL)


def raster_fill(raster: DataFrame, grid: DataFrame, size: int = 5) -> DataFrame:
    """Raster with the holes of its closed mask filled by the mean of the filled cells around them, ring by ring as long as a round
    fills any. Closed cells that no ring reaches, such as a corner between far apart cells, touch no filled cell and stay open."""
    holes = checkpointed(close_mask(raster, grid, size).join(raster.select(*CELL), CELL, "left_anti"))
    full = checkpointed(raster.select(*CELL, *[F.col(c).cast("double").alias(c) for c in ("z", "r", "g", "b")], F.lit(False).alias("filled")))
    ring = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    kernel = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ring])
    edge = full  # a hole left by a round touches nothing but what that round filled
    while True:
        around = holes.select(*[F.col(c).alias("_" + c) for c in CELL], F.explode(kernel).alias("_o")).selectExpr(
            "*", f"_{FLIGHT} AS {FLIGHT}", "_row + _o.dy AS row", "_col + _o.dx AS col")
        near = shuffled(around).join(edge, CELL).select(*[F.col("_" + c).alias(c) for c in CELL], "z", "r", "g", "b")
        new = checkpointed(near.groupBy(*CELL).agg(*[F.avg(c).alias(c) for c in ("z", "r", "g", "b")]).withColumn("filled", F.lit(True)))
        if not new.limit(1).count():
            break
        full, edge = full.unionByName(new), new
        holes = checkpointed(holes.join(new.select(*CELL), CELL, "left_anti"))
    return full


def dtm(raster: DataFrame, grid: DataFrame, size: int = 15, lift: float = 0.3) -> DataFrame:
    """Bare ground: surface opened by an ellipse in 256 height steps, never above the surface.

    Cells without data count as the lowest step, cells off the raster do not count.
    """
    g = checkpointed(grid.select(FLIGHT, "width", "height", "z_min", "z_max"))
    span = F.greatest(F.lit(1e-4), F.col("z_max") - F.col("z_min"))
    d = attach(raster.select(*CELL, "z"), g, FLIGHT, "inner", compute_once=False)
    d = checkpointed(d.withColumn("q", F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("z") - F.col("z_min")) / span)) * 255.0)))
    # Erosion: the least step around a cell; a missing neighbour on the raster makes it zero.
    rows = d.count()
    seen = _offsets(_tiled(d.select(*CELL, "q"), rows), size).groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"), F.min("q").alias("_q"))
    low = attach(seen, g, FLIGHT, "inner", compute_once=False).filter(F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1))
    low = low.withColumn("_e", F.when(F.col("_n") == _on_raster(size), F.col("_q")).otherwise(0)).filter(F.col("_e") > 0).select(*CELL, "_e")
    # No cell stands without its whole ellipse, so there are no more of them than of `d`, except where rasters end.
    back = _offsets(_tiled(low, rows), size).groupBy(*CELL).agg(F.max("_e").alias("_open"))
    out = d.join(back, CELL, "left").withColumn("_open", F.coalesce("_open", F.lit(0)))
    ground = F.col("_open") / 255.0 * (F.col("z_max") - F.col("z_min")) + F.col("z_min") + lift
    return out.select(*CELL, F.least(F.col("z"), ground).alias("z"))


def building_footprint(vertices: DataFrame, datum: DataFrame | None = None, rise: float = 2.5, min_points: int = 30) -> DataFrame:
    """Box around the vertices well above ground (12th percentile): extent, height and area; geodetic corners with a datum."""
    base = exact_quantiles(vertices, FLIGHT, "z", {"z_ground": 0.12})
    d = attach(vertices, base, FLIGHT, "inner").filter(F.col("z") > F.col("z_ground") + rise)
    g = d.groupBy(FLIGHT).agg(F.count(F.lit(1)).alias("points"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
                              F.max("z").alias("_top"), F.first("z_ground").alias("z_ground")).filter(F.col("points") >= min_points)
    g = g.withColumns({"height_m": F.col("_top") - F.col("z_ground"), "area_m2": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))}).drop("_top")
    if datum is None:
        return g
    g = g.join(datum, FLIGHT)
    for i, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))):
        lat, lon, _ = geodesy.enu_to_geodetic(x, y, "z_ground", "ref_lat", "ref_lon", "ref_alt")
        g = g.withColumns({f"lat{i}": F.round(lat, 7), f"lon{i}": F.round(lon, 7)})
    return g


def measurements(raster: DataFrame, grid: DataFrame, vertices: DataFrame, face_areas: DataFrame | None = None) -> DataFrame:
    """Extent, footprint, built volume over the 12th height percentile and surface area of each flight."""
    base = exact_quantiles(vertices, FLIGHT, "z", {"z_datum": 0.12})
    g = grid.join(base, FLIGHT)
    cell = F.col("gsd_x") * F.col("gsd_y")
    d = attach(raster.select(*CELL, "z"), g, FLIGHT, "inner")
    m = d.groupBy(FLIGHT).agg((F.count(F.lit(1)) * F.first(cell)).alias("footprint_m2"), (F.sum(F.greatest(F.lit(0.0), F.col("z") - F.col("z_datum"))) * F.first(cell)).alias("volume_m3"))
    out = grid.join(m, FLIGHT, "left").withColumns({"gsd": (F.col("gsd_x") + F.col("gsd_y")) / 2, "height_z": F.col("z_max") - F.col("z_min")})
    if face_areas is not None:
        out = out.join(face_areas.groupBy(FLIGHT).agg(F.sum("area").alias("surface_m2")), FLIGHT, "left")
    return out


def world_file(grid: DataFrame) -> DataFrame:
    """Six-line affine text of each raster."""
    zero = F.lit("0.00000000")
    num = lambda c: F.format_string("%.8f", c)
    return grid.select(FLIGHT, F.concat_ws("\n", num(F.col("gsd_x")), zero, zero, num(-F.col("gsd_y")), num(F.col("x_min") + F.col("gsd_x") * 0.5),
                                           num(F.col("y_max") - F.col("gsd_y") * 0.5)).alias("text"))
