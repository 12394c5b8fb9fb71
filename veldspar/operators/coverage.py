"""Coverage of an eligible grid by selected tie points: occupancy, hull, largest empty run, counts by cell; eligibility from masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.operators.tiepoints import with_cells


def hull(points: Column) -> Column:
    """Corners of the convex hull of an array of structs (line, sample), counter-clockwise from the least; two for collinear points."""

    @F.arrow_udf("array<struct<line:double,sample:double>>")
    def corners(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            if row is None:
                out.append(None)
                continue
            pts = sorted({(p["line"], p["sample"]) for p in row})
            sides = []
            for order in (pts, pts[::-1]):
                side: list[tuple[float, float]] = []
                for q in order:
                    while len(side) >= 2 and (side[-1][0] - side[-2][0]) * (q[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (q[0] - side[-2][0]):
                        side.pop()
                    side.append(q)
                sides.append(side[:-1] if len(side) > 1 else side)
            ring = sides[0] + sides[1] if len(pts) > 1 else pts
            out.append([{"line": a, "sample": b} for a, b in ring])
        return pa.array(out, pa.list_(pa.struct([("line", pa.float64()), ("sample", pa.float64())])))

    return corners(points)


def ring_area(ring: Column) -> Column:
    """Area of a polygon given as an array of structs (line, sample)."""
    after = F.concat(F.slice(ring, 2, 1 << 30), F.slice(ring, 1, 1))
    twice = F.aggregate(F.zip_with(ring, after, lambda p, q: p["line"] * q["sample"] - q["line"] * p["sample"]), F.lit(0.0), lambda a, x: a + x)
    return F.abs(twice) / 2


def largest_region(cells: Column, rows: int, cols: int) -> Column:
    """Size of the largest 4-connected region of true cells; cells: array<boolean> in row order."""

    @F.arrow_udf("long")
    def largest(grids: pa.Array) -> pa.Array:
        open_ = np.asarray(grids.flatten().to_numpy(zero_copy_only=False), bool).reshape(len(grids), rows, cols)
        none = rows * cols
        label = np.where(open_, np.arange(none).reshape(rows, cols), none)
        while True:
            framed = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=none)
            least = np.minimum.reduce([label, framed[:, :-2, 1:-1], framed[:, 2:, 1:-1], framed[:, 1:-1, :-2], framed[:, 1:-1, 2:]])
            least = np.where(open_, least, none)
            if (least == label).all():
                break
            label = least
        n = np.zeros((len(grids), none + 1), np.int64)
        np.add.at(n, (np.repeat(np.arange(len(grids)), none), label.reshape(-1)), 1)
        return pa.array(n[:, :none].max(1) if len(grids) else np.zeros(0, np.int64))

    return largest(cells)


def cell_counts(points: DataFrame, height: float, width: float, grid: int = 8) -> DataFrame:
    """job_id, row, col, n: inliers of each cell that has any."""
    return with_cells(points.where("is_inlier"), height, width, grid).groupBy("job_id", "row", "col").agg(F.count(F.lit(1)).alias("n"))


def coverage_metrics(points: DataFrame, eligible: DataFrame, height: float, width: float, grid: int = 8) -> DataFrame:
    """Per job: eligible_cells, occupancy of the eligible cells (0 without any), hull_ratio (area of the selected points' hull over the eligible area;
    null below three points or without eligible cells) and largest_empty_run (4-connected eligible cells without a selected point).

    points: job_id, line, sample, is_inlier, selected. eligible: row, col, eligible, and job_id if grids differ by job. A job has at most grid * grid selected cells."""
    each = [*(["job_id"] if "job_id" in eligible.columns else [])]
    at = F.col("row") * grid + F.col("col")
    cells = eligible.groupBy(*each).agg(F.collect_set(F.when(F.col("eligible"), at)).alias("cells"))  # at most a grid's cells
    chosen = with_cells(points.where("is_inlier and selected"), height, width, grid)
    jobs = points.select("job_id").distinct()
    picked = chosen.groupBy("job_id").agg(F.collect_set(at).alias("taken"), F.collect_list(F.struct(F.col("line").cast("double").alias("line"), F.col("sample").cast("double").alias("sample"))).alias("pts"))
    rows = jobs.join(picked, "job_id", "left")
    rows = rows.join(cells, "job_id", "left") if each else rows.join(F.broadcast(cells))  # one row
    rows = rows.withColumn("taken", F.coalesce("taken", F.array().cast("array<int>"))).withColumn("cells", F.coalesce("cells", F.array().cast("array<int>")))
    n = F.size("cells")
    empty = F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), lambda i: F.array_contains("cells", i) & ~F.array_contains("taken", i))
    area = ring_area(hull(F.col("pts")))
    ratio = F.when((F.coalesce(F.size("pts"), F.lit(0)) >= 3) & (n > 0), area / (n * F.lit(height / grid * (width / grid))))
    return rows.select("job_id", n.cast("long").alias("eligible_cells"), F.coalesce(F.try_divide(F.size("taken").cast("double"), n.cast("double")), F.lit(0.0)).alias("occupancy"), ratio.alias("hull_ratio"), largest_region(empty, grid, grid).alias("largest_empty_run"))


def _usable_cells(pixels: DataFrame, name: str, grid: int) -> DataFrame:
    """The grid cell of a pixel by whole-number bounds: cell k of n over an extent e holds the pixels from k * e // n on."""
    size = pixels.groupBy("image_id").agg((F.max("line") + 1).alias("_h"), (F.max("sample") + 1).alias("_w"))
    cell = lambda c, e: F.floor(((F.col(c) + 1) * grid - 1) / F.col(e)).cast("int")
    rows = pixels.join(size, "image_id").withColumn("row", cell("line", "_h")).withColumn("col", cell("sample", "_w"))
    return rows.groupBy("image_id", "row", "col").agg(F.bool_or("valid").alias(name))


def local_eligibility(source: DataFrame, reference: DataFrame, grid: int = 8) -> DataFrame:
    """image_id, row, col, eligible, exclusion_reason: a cell is eligible if it has a valid pixel in the source and, in its own grid, in the reference."""
    images = source.select("image_id").distinct()
    every = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))).alias("i")).select("image_id", F.floor(F.col("i") / grid).cast("int").alias("row"), (F.col("i") % grid).cast("int").alias("col"))
    both = every.join(_usable_cells(source, "s", grid), ["image_id", "row", "col"], "left").join(_usable_cells(reference, "r", grid), ["image_id", "row", "col"], "left")
    ok = F.coalesce(F.col("s") & F.col("r"), F.lit(False))
    return both.select("image_id", "row", "col", ok.alias("eligible"), F.when(~ok, "source or normalized reference grid cell has no usable local pixels").alias("exclusion_reason"))


def grid_violations(eligible: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cells outside the grid's shape, given twice, or not eligible without a reason."""
    n = F.count(F.lit(1)).over(Window.partitionBy("row", "col"))
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    why = F.when(~F.coalesce(inside, F.lit(False)), "outside_grid").when(n > 1, "repeated_cell").when(~F.col("eligible") & (F.coalesce(F.trim("exclusion_reason"), F.lit("")) == ""), "missing_reason")
    return eligible.withColumn("violation", why).where("violation is not null")
