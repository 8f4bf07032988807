"""What is nearest to a point, or the biggest within reach of it, by grids of ever finer cells.

A cell knows how far its spots spread and the best of them. From grid to grid a point keeps the cells that may still hold
its answer: none that begins farther away than another one ends, and none whose best is beaten by what surely lies
within reach. So a point looks at a few cells of every grid and at the spots of the last one, however many
spots there are and however far away they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agro_jobs.sources.shared import written

WIDEST, FINER = 360.0, 4  # degrees of the cells that the first grid divides, and into how many each way
FEW, DEEPEST = 32, 14  # the grids end where no cell has more spots than a few
SENT = 200_000  # cells of a grid that are broadcast
BLUR = 1e-5  # kilometres: more than distances are rounded by
SPREAD = ("south", "north", "west", "east")


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a flat earth, good for the short distances names are matched over."""
    x = (lon1 - lon2) * F.cos(F.radians((lat1 + lat2) / 2)) * 111.32
    return F.sqrt(x * x + F.pow((lat1 - lat2) * 111.32, F.lit(2.0)))


def _cell(c: str, level: int) -> Column:
    return F.floor(F.col(c) / (WIDEST / FINER**level)).cast("long")


def _grids(spots: DataFrame, nearest: bool) -> list[tuple[DataFrame, bool]]:
    """The grids from wide to fine, and whether each is small."""
    out = []
    for level in range(1, DEEPEST + 1):
        spread = [F.min("lat2").alias("south"), F.max("lat2").alias("north"), F.min("lon2").alias("west"), F.max("lon2").alias("east")]
        best = [] if nearest else [F.max("item").alias("best")]
        cells = written(spots.groupBy("kind", _cell("lat2", level).alias("cy"), _cell("lon2", level).alias("cx")).agg(F.count("*").alias("n"), *spread, *best), "grid")
        most, many = cells.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
        out.append((cells.drop("n"), many <= SENT))
        if most <= FEW:
            break
    return out


def _between() -> tuple[Column, Column]:
    """The least and the greatest `flat_distance` that a spot of a cell can have."""
    lat, lon, south, north, west, east = (F.col(c) for c in ("lat", "lon", *SPREAD))
    zero, a, b = F.lit(0.0), (lat + south) / 2, (lat + north) / 2
    proper = (a >= -90) & (b <= 90)
    narrow = F.when(proper, F.greatest(zero, F.least(F.cos(F.radians(a)), F.cos(F.radians(b))))).otherwise(0.0)
    wide = F.when(proper & ((a > 0) | (b < 0)), F.greatest(F.cos(F.radians(a)), F.cos(F.radians(b)))).otherwise(1.0)
    y0, y1 = F.greatest(zero, south - lat, lat - north), F.greatest(F.abs(lat - south), F.abs(lat - north))
    x0, x1 = F.greatest(zero, west - lon, lon - east) * narrow, F.greatest(F.abs(lon - west), F.abs(lon - east)) * wide
    return F.sqrt(x0 * x0 + y0 * y0) * 111.32 - BLUR, F.sqrt(x1 * x1 + y1 * y1) * 111.32 + BLUR


def _found(points: DataFrame, spots: DataFrame, km: Column, reach: float | None, nearest: bool) -> DataFrame:
    grids, left = _grids(spots, nearest), points
    near, far = _between()
    within = F.lit(True) if reach is None else F.col("near") <= reach
    same = Window.partitionBy("kind", "lat", "lon")
    for i, (cells, small) in enumerate(grids):
        keys = ["kind"]
        if i:
            cells, keys = cells.withColumns({"py": F.floor(F.col("cy") / FINER), "px": F.floor(F.col("cx") / FINER)}), ["kind", "py", "px"]
        seen = left.join(F.broadcast(cells) if small else cells, keys).withColumns({"near": near, "far": far}).where(within)
        if nearest:
            seen = seen.withColumn("_s", F.min("far").over(same)).where(F.col("near") <= F.col("_s"))
        else:
            seen = seen.withColumn("_s", F.max(F.when(F.col("far") <= reach, F.col("best"))).over(same)).where(F.col("_s").isNull() | (F.col("best") >= F.col("_s")))
        left = seen.select("kind", "lat", "lon", F.col("cy").alias("py"), F.col("cx").alias("px"))
    last = spots.withColumns({"py": _cell("lat2", len(grids)), "px": _cell("lon2", len(grids))})
    met = left.join(last, ["kind", "py", "px"]).withColumn("km", km)
    return met if reach is None else met.where(F.col("km") <= reach)


def _known(rows: DataFrame, lat: str, lon: str) -> DataFrame:
    return rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon))


def nearest(points: DataFrame, spots: DataFrame, reach: float | None = None) -> DataFrame:
    """kind, lat, lon, km, item: for each place of points (kind, lat, lon) the nearest spot (kind, lat2, lon2, item) of its kind, ties to the smaller item, not beyond `reach`.

    Kilometres are rounded to six digits.
    """
    km = F.round(flat_distance(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6)
    one = written(_known(spots, "lat2", "lon2").groupBy("kind", "lat2", "lon2").agg(F.min("item").alias("item")), "spots")
    met = _found(_known(points, "lat", "lon").select("kind", "lat", "lon").distinct(), one, km, reach, True)
    return met.groupBy("kind", "lat", "lon").agg(F.min(F.struct("km", "item")).alias("m")).select("kind", "lat", "lon", "m.km", "m.item")


def biggest(points: DataFrame, spots: DataFrame, reach: float) -> DataFrame:
    """kind, lat, lon, km, item: for each place of points (kind, lat, lon) the largest item of the spots (kind, lat2, lon2, item) of its kind within reach."""
    km = flat_distance(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    one = written(_known(spots, "lat2", "lon2").groupBy("kind", "lat2", "lon2").agg(F.max("item").alias("item")), "spots")
    met = _found(_known(points, "lat", "lon").select("kind", "lat", "lon").distinct(), one, km, reach, False)
    return met.groupBy("kind", "lat", "lon").agg(F.max(F.struct("item", "km")).alias("m")).select("kind", "lat", "lon", "m.km", "m.item")
