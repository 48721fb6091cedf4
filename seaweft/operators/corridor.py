"""Route corridors: cross-sections along each edge, a Gaussian fit of the lateral offsets, centre line and band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SQUARE, MIN_STRIP, MIN_LENGTH = 10, 5, 1e-7


def slices(nodes: DataFrame, edges: DataFrame, m: int) -> DataFrame:
    """m evenly spaced slices of every edge whose ends are known and apart, with direction (vx, vy) and place (cx, cy)."""
    end = lambda p: nodes.select(F.col("port_id").alias(p), F.col("lon").alias(f"{p}_x"), F.col("lat").alias(f"{p}_y"))
    e = edges.select(F.col("source_port").alias("source"), F.col("target_port").alias("target")).join(end("source"), "source").join(end("target"), "target")
    dx, dy = F.col("target_x") - F.col("source_x"), F.col("target_y") - F.col("source_y")
    e = e.withColumn("dx", dx).withColumn("dy", dy).withColumn("length", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where(F.col("length") >= MIN_LENGTH)
    part = F.col("slice") / F.lit(float(m + 1))
    return e.withColumn("slice", F.explode(F.sequence(F.lit(1), F.lit(m)))).select(
        "source", "target", "slice", "length", (F.col("dx") / F.col("length")).alias("vx"), (F.col("dy") / F.col("length")).alias("vy"),
        (F.col("source_x") + part * F.col("dx")).alias("cx"), (F.col("source_y") + part * F.col("dy")).alias("cy"),
    )


def near(slice_table: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Slices with the points in the square of half-width `radius` around them, edges of the square included.

    A range join as an equality join: points fall into one bucket as wide as the radius, and a slice looks in the nine
    that its square touches.
    """
    bucket = lambda c: F.floor(c / radius).cast("int")
    around = lambda c: F.explode(F.sequence(bucket(F.col(c) - radius), bucket(F.col(c) + radius)))
    s = slice_table.withColumn("bx", around("cx")).withColumn("by", around("cy"))
    p = points.where("lon is not null and lat is not null").select("lon", "lat", bucket(F.col("lon")).alias("bx"), bucket(F.col("lat")).alias("by"))
    inside = F.col("lon").between(F.col("cx") - radius, F.col("cx") + radius) & F.col("lat").between(F.col("cy") - radius, F.col("cy") + radius)
    return s.join(p, ["bx", "by"]).where(inside).drop("bx", "by")


def fit_slices(points: DataFrame, nodes: DataFrame, edges: DataFrame, *, m: int = 10, radius: float = 0.1, strip: float = 2.0, band: float = 3.0) -> DataFrame:
    """Mean and population deviation of the lateral offsets in each slice's strip, with its centre and band.

    A slice needs ten points in its square and five in its strip, which is length / (strip * m) to either side.
    """
    rx, ry = F.col("lon") - F.col("cx"), F.col("lat") - F.col("cy")
    along, across = rx * F.col("vx") + ry * F.col("vy"), ry * F.col("vx") - rx * F.col("vy")
    found = near(slices(nodes, edges, m), points, radius).withColumn("offset", F.when(F.abs(along) < F.col("length") / (strip * m), across))
    keys = ["source", "target", "slice", "cx", "cy", "vx", "vy"]
    fitted = found.groupBy(*keys).agg(F.count("*").alias("n_square"), F.count("offset").alias("n_strip"), F.avg("offset").alias("mu"), F.stddev_pop("offset").alias("sigma")).where((F.col("n_square") >= MIN_SQUARE) & (F.col("n_strip") >= MIN_STRIP))

    def at(shift: Column) -> Column:
        return F.struct((F.col("cx") - F.col("vy") * shift).alias("lon"), (F.col("cy") + F.col("vx") * shift).alias("lat"))

    wide = band * F.col("sigma")
    return fitted.withColumns({"centre": at(F.col("mu")), "left": at(F.col("mu") + wide), "right": at(F.col("mu") - wide)})


def routes(fitted: DataFrame) -> DataFrame:
    """(source, target, n_slices, line, corridor): centre line in the order of slices; band up the left, down the right, closed."""
    lists = fitted.groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("slice", "centre", "left", "right"))).alias("s"))
    pick = lambda n: F.transform("s", lambda x: x[n])
    ring = F.concat(pick("left"), F.reverse(pick("right")), F.slice(pick("left"), 1, 1))
    return lists.select("source", "target", F.size("s").alias("n_slices"), pick("centre").alias("line"), ring.alias("corridor"))
