"""Queries on shapes that Spark makes from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shapes import CONTOURS, type_primitives
from ..sources.svg import svg_shapes


def embedding_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, contours, stroke_width): a shape of every vector, whose numbers bend a ring, a polyline, a ribbon or a
    ring with a hole, by its label."""
    e = lambda i: F.element_at("embedding", (i % F.size("embedding") + 1).cast("int")).cast("double")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    steps = lambda n: F.sequence(F.lit(0), F.lit(n - 1))

    def ring(radius: float, n: int, noise: float) -> Column:
        return F.transform(steps(n), lambda i: point(radius * (1 + noise * e(i)) * F.cos(i * 6.283185307179586 / n), 0.7 * radius * (1 + noise * e(i)) * F.sin(i * 6.283185307179586 / n)))

    height = lambda i: (0.2 + e(F.lit(1))) * (i * (31 - i)) / 4
    line = F.transform(steps(32), lambda i: point(i * 3, e(i) * e(F.lit(0)) * 12 + height(i)))
    ribbon = F.concat(F.transform(steps(32), lambda i: point(i * 3, height(i) + 2)), F.transform(steps(32), lambda i: point(93 - i * 3, height(31 - i))))
    contour = lambda points, closed: F.struct(points.alias("points"), F.lit(closed).alias("is_closed"))
    form = F.col("label") % 4
    contours = (
        F.when(form == 0, F.array(contour(ring(10.0, 32, 0.9), True)))
        .when(form == 1, F.array(contour(line, False)))
        .when(form == 2, F.array(contour(ribbon, True)))
        .otherwise(F.array(contour(ring(10.0, 24, 0.5), True), contour(ring(5.0, 16, 0.5), True)))
    )
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", contours.cast(CONTOURS).alias("contours"), F.lit(0.5).alias("stroke_width"))


def q_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = type_primitives(embedding_shapes(spark, sf_dir), ["vec_id"])
    return typed.select("vec_id", "kind", "stroke_reason", "curve_reason", F.size("curve.centerline").alias("samples"), "ellipse.is_hollow")


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, svg): ten customers a page, each a group with a rectangle and an open path."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(
        F.lit('<g transform="translate('), F.col("c_custkey") % 100, F.lit(" "), F.col("c_nationkey"), F.lit(')" stroke="black" stroke-width="'), F.col("c_custkey") % 3,
        F.lit('"><rect x="1" y="2" width="'), F.col("c_nationkey") + 1, F.lit('" height="4"/><path fill="none" d="M 3 4 h '), F.col("c_custkey") % 7 + 1, F.lit(' v 5"/></g>'),
    )
    drawn = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", text.alias("text")))), lambda x: x["text"]), "")
    pages = c.groupBy(F.floor(F.col("c_custkey") / 10).alias("page")).agg(drawn.alias("drawn"))
    return pages.select("page", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><g transform="matrix(2 0 0 2 1 0)">'), "drawn", F.lit("</g></svg>")).alias("svg"))


def q_svg_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes, _ = svg_shapes(customer_pages(spark, sf_dir), ["page"])
    return shapes.select("page", "shape_id", "source_kind", "is_closed", "stroke_width", "has_stroke", "bounds.min_x", "bounds.min_y", "bounds.max_x", "bounds.max_y", F.size(F.element_at("contours", 1)["points"]).alias("n_points"))


QUERIES = {"q_primitives": q_primitives, "q_svg_shapes": q_svg_shapes}

SQL = {
    "q_svg_shapes": """
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey // 10 AS page, row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey) AS nth FROM customer),
s AS (
  SELECT page, 2 * nth - 1 AS i, 'rect' AS source_kind, true AS is_closed, k, n, 1 AS x0, 2 AS y0, n + 2 AS x1, 6 AS y1, 5 AS n_points FROM c
  UNION ALL SELECT page, 2 * nth, 'path', false, k, n, 3, 4, k % 7 + 4, 9, 3 FROM c)
SELECT page, 'shape-' || i AS shape_id, source_kind, is_closed, (k % 3 * 2)::DOUBLE AS stroke_width, k % 3 > 0 AS has_stroke,
       (2 * (x0 + k % 100) + 1)::DOUBLE AS min_x, (2 * (y0 + n))::DOUBLE AS min_y, (2 * (x1 + k % 100) + 1)::DOUBLE AS max_x, (2 * (y1 + n))::DOUBLE AS max_y, n_points
FROM s
""",
}
