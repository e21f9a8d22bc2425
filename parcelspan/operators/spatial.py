"""Point in polygon and nearest neighbour, without pairing every point with every shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspan.functions.geo import EARTH_RADIUS_M, haversine_m
from parcelspan.session import run_folder

# The cells shapes are filed under: their size, and how far their lines are shifted so that no written coordinate lies on one.
CELL_DEG, CELL_SHIFT, CELL_MARGIN = 0.004, 0.00012345678912345, 1e-9
EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
CELL_M, WIDEN = 8_000.0, 4  # edge of the first grid's cells, and how much wider each next one's are


def ring_edges(rings: DataFrame, shape: str, points: str) -> DataFrame:
    """Edges of closed rings: `points` is an array of {lon, lat} whose last point repeats the first."""
    segments = F.zip_with(
        F.slice(F.col(points), F.lit(1), F.size(points) - 1),
        F.slice(F.col(points), F.lit(2), F.size(points) - 1),
        lambda a, b: F.struct(a.lon.alias("x1"), a.lat.alias("y1"), b.lon.alias("x2"), b.lat.alias("y2")),
    )
    return rings.select(shape, F.explode(segments).alias("e")).select(shape, "e.*")


def _cell(degrees: Column, size: float) -> Column:
    return F.floor((degrees - F.lit(CELL_SHIFT)) / F.lit(size)).cast("bigint")


def _line(cell: Column, size: float, share: float) -> Column:
    """The coordinate that lies at a share of a cell's width."""
    return (cell + F.lit(share)) * F.lit(size) + F.lit(CELL_SHIFT)


def _x_at(e: Column, y: Column) -> Column:
    return e.x1 + (y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)


def shape_cells(edges: DataFrame, shape: str, size: float = CELL_DEG) -> DataFrame:
    """The cells (cx, cy) of a grid that a shape reaches: the edges that touch the cell, none for a cell wholly inside, and whether the
    middle of the cell's east side lies inside. From there a point of the cell is told by the cell's own edges.

    An edge is filed under the cells it runs through, row by row; the array of a cell is as long as the shape is detailed there. Cells
    wholly inside come from the crossings of the shape with the middle line of each row.
    """
    rows = edges.withColumn("cy", F.explode(F.sequence(_cell(F.least("y1", "y2"), size), _cell(F.greatest("y1", "y2"), size))))
    e = F.col("e")
    boxed = rows.select(shape, "cy", F.struct("x1", "y1", "x2", "y2").alias("e"))
    # The stretch of the edge inside its row of cells; a level edge is in one row and runs its whole length.
    ends = [
        F.when(e.y1 == e.y2, x).otherwise(
            _x_at(e, F.least(F.greatest(_line(F.col("cy"), size, share), F.least(e.y1, e.y2)), F.greatest(e.y1, e.y2)))
        )
        for x, share in ((e.x1, 0.0), (e.x2, 1.0))
    ]
    reached = F.sequence(_cell(F.least(*ends) - F.lit(CELL_MARGIN), size), _cell(F.greatest(*ends) + F.lit(CELL_MARGIN), size))
    touched = boxed.withColumn("cx", F.explode(reached)).groupBy(shape, "cx", "cy").agg(F.collect_list("e").alias("edges"))

    middle = _line(F.col("cy"), size, 0.5)
    crossed = boxed.where((e.y1 > middle) != (e.y2 > middle)).groupBy(shape, "cy").agg(F.array_sort(F.collect_list(_x_at(e, middle))).alias("xs"))
    spans = F.transform(F.sequence(F.lit(1), F.size("xs"), F.lit(2)), lambda k: F.struct(F.get("xs", k - 1).alias("a"), F.get("xs", k).alias("b")))
    inner = crossed.select(shape, "cy", F.explode(spans).alias("s"))
    # The east sides from a up to but not including b.
    first, after = [F.ceil((x - F.lit(CELL_SHIFT)) / F.lit(size)).cast("bigint") - 1 for x in (F.col("s.a"), F.col("s.b"))]
    inner = inner.where(first < after).select(shape, F.explode(F.sequence(first, after - 1)).alias("cx"), "cy", F.lit(True).alias("east_inside"))
    return touched.join(inner, [shape, "cx", "cy"], "full_outer").select(
        shape, "cx", "cy", "edges", F.coalesce("east_inside", F.lit(False)).alias("east_inside"), F.lit(size).alias("cell_deg")
    )


def _inside(lon: Column, lat: Column) -> Column:
    """Whether a point is inside the shape of the cell it was joined with, by the even-odd rule: the edges crossed on the way due east to
    the cell's side and then along it to its middle, from what is known there."""
    side, middle = _line(F.col("cx"), F.col("cell_deg"), 1.0), _line(F.col("cy"), F.col("cell_deg"), 0.5)

    def odd(e: Column) -> Column:
        x = _x_at(e, lat)
        level = ((e.y1 > lat) != (e.y2 > lat)) & (lon < x) & (x <= side)
        y = e.y1 + (side - e.x1) * (e.y2 - e.y1) / (e.x2 - e.x1)
        return F.coalesce(level, F.lit(False)) != F.coalesce(((e.x1 > side) != (e.x2 > side)) & ((lat < y) != (middle < y)), F.lit(False))

    crossings = F.size(F.filter(F.coalesce("edges", F.array().cast(EDGES)), odd))
    return F.col("east_inside") != (crossings % 2 == 1)


def _with_cell(points: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    return points.withColumn("cx", _cell(F.col(lon), size)).withColumn("cy", _cell(F.col(lat), size))


def inside_own_shape(points: DataFrame, cells: DataFrame, shape: str, lon: str, lat: str, into: str, size: float = CELL_DEG) -> DataFrame:
    """Whether each point lies in the shape it names, by the even-odd rule over all of its rings."""
    own = _with_cell(points, lon, lat, size).join(cells, [shape, "cx", "cy"], "left")
    return own.select(*points.columns, F.coalesce(_inside(F.col(lon), F.col(lat)), F.lit(False)).alias(into))


def containing_shapes(points: DataFrame, cells: DataFrame, shape: str, lon: str, lat: str, size: float = CELL_DEG) -> DataFrame:
    """One row per point and shape that contains it; a point meets only the shapes of its cell."""
    met = _with_cell(points, lon, lat, size).join(cells, ["cx", "cy"])
    return met.where(_inside(F.col(lon), F.col(lat))).select(*points.columns, shape)


def _on_sphere(lat: str, lon: str) -> list[Column]:
    """A place on the sphere in metres from its centre: no seam at the antimeridian, no poles."""
    y, x = F.radians(F.col(lat)), F.radians(F.col(lon))
    return [F.lit(EARTH_RADIUS_M) * c for c in (F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y))]


def nearest_site(
    points: DataFrame, sites: DataFrame, site: str, lat: str, lon: str, cell_m: float = CELL_M
) -> DataFrame:
    """The nearest site of every point (ties to the lower id) as `nearest` and `distance_m`.

    `sites` has columns (site, lat, lon). Sites are filed under their cell of a cubic grid and the 26 around it, so a point
    reads the sites of its own cell and a find nearer than a cell's edge is certain. Places without one go on with wider
    cells, each round from what the last has written; the last cells are wider than the globe. Points without a latitude
    or longitude have no nearest site; sites without one are never near. Repeated points are searched once and all kept.
    """
    spark = points.sparkSession
    named = sites.select(F.col(site).alias("_s"), F.col(lat).alias("_sy"), F.col(lon).alias("_sx"))
    named = named.where("_s IS NOT NULL AND _sy IS NOT NULL AND _sx IS NOT NULL")
    places = points.select(F.col(lat).alias("_py"), F.col(lon).alias("_px")).where("_py IS NOT NULL AND _px IS NOT NULL").distinct()
    best_of = "struct<distance_m:double,nearest:" + sites.schema[site].dataType.simpleString() + ">"
    found, left, width = None, places, cell_m
    while True:
        last = width > 2 * EARTH_RADIUS_M
        cell = lambda parts, width=width: [F.floor(p / F.lit(width)).alias(f"_c{i}") for i, p in enumerate(parts)]
        filed = named.select("_s", "_sy", "_sx", *cell(_on_sphere("_sy", "_sx")))
        for i in range(3):
            steps = F.explode(F.array(*[F.col(f"_c{i}") + d for d in (-1, 0, 1)]))
            filed = filed.withColumn(f"_c{i}", steps)
        met = left.select("_py", "_px", *cell(_on_sphere("_py", "_px"))).join(filed, ["_c0", "_c1", "_c2"], "left")
        near = F.struct(haversine_m(F.col("_py"), F.col("_px"), F.col("_sy"), F.col("_sx")).alias("distance_m"), F.col("_s").alias("nearest"))
        best = met.groupBy("_py", "_px").agg(F.min(F.when(F.col("_s").isNotNull(), near)).cast(best_of).alias("_b"))
        sure = F.lit(True) if last else F.coalesce(F.col("_b.distance_m") < width, F.lit(False))
        path = run_folder(spark, "nearest")
        best.withColumn("_sure", sure).write.parquet(path)
        done = spark.read.parquet(path)
        found = done.where("_sure") if found is None else found.unionByName(done.where("_sure"))
        left = done.where("NOT _sure").select("_py", "_px")
        if last or left.isEmpty():
            break
        width *= WIDEN
    by_place = found.select("_py", "_px", "_b.nearest", "_b.distance_m")
    return points.join(by_place, (F.col(lat) == F.col("_py")) & (F.col(lon) == F.col("_px")), "left").select(
        *points.columns, "nearest", "distance_m"
    )
