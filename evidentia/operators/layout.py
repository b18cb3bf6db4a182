"""Fields from where lines stand on a document: a spatial join of template boxes with line boxes.

Boxes are fractions of the page, (x0, y0) left above (x1, y1). Both sides are dealt to the cells of a grid that their boxes touch
and meet by document type and cell; a pair counts only in the cell of its intersection's first corner, so none comes twice.
What stays is the share of the line's box that lies in the template's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import intake

GRID = 16
#: Least share of a line's box that lies in a template's box.
INSIDE = 0.5

# Where each type's fields stand, as fractions of width and height.
TEMPLATES = {
    "aadhaar": [("surname", 0.31, 0.220, 0.72, 0.272), ("date_of_birth", 0.30, 0.280, 0.99, 0.325), ("sex", 0.30, 0.330, 0.60, 0.375), ("document_number", 0.28, 0.795, 0.72, 0.860), ("issue_date", 0.005, 0.180, 0.100, 0.800)],
    "pan_card": [("document_number", 0.30, 0.270, 0.88, 0.420), ("surname", 0.47, 0.530, 0.92, 0.620), ("date_of_birth", 0.47, 0.800, 0.92, 0.885)],
    "driving_license": [("surname", 0.42, 0.238, 0.97, 0.320), ("date_of_birth", 0.42, 0.370, 0.97, 0.450), ("document_number", 0.24, 0.890, 0.55, 0.960), ("date_of_expiry", 0.81, 0.835, 0.995, 0.945)],
}
BOX = ["x0", "y0", "x1", "y1"]


def templates(spark: SparkSession) -> DataFrame:
    """document_type, name, seq and the box of each template's field."""
    rows = [(t, n, k, *box) for t, fields in TEMPLATES.items() for k, (n, *box) in enumerate(fields)]
    return spark.createDataFrame(rows, "document_type string, name string, seq int, x0 double, y0 double, x1 double, y1 double")


def _cell(fraction: Column, grid: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(fraction * grid))).cast("int")


def box_join(left: DataFrame, right: DataFrame, keys: list[str], grid: int = GRID) -> DataFrame:
    """Rows of ``left`` and ``right`` of equal keys whose boxes overlap: left's columns, right's others but its box, and share, of left's area.

    A box without an area, or with a null, overlaps nothing.
    """
    area = lambda p="": (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    real = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))

    def dealt(rows: DataFrame) -> DataFrame:
        columns, lines = (F.sequence(_cell(F.col(f"{axis}0"), grid), _cell(F.col(f"{axis}1"), grid)) for axis in "xy")
        rows = rows.where(real).withColumn("__x", F.explode(columns))
        return rows.withColumn("__y", F.explode(lines))

    other = dealt(right).withColumnsRenamed({c: f"__{c}" for c in BOX})
    met = dealt(left).join(other, [*keys, "__x", "__y"])
    low = {a: F.greatest(f"{a}0", f"__{a}0") for a in "xy"}
    size = {a: F.least(f"{a}1", f"__{a}1") - low[a] for a in "xy"}
    first = (_cell(low["x"], grid) == F.col("__x")) & (_cell(low["y"], grid) == F.col("__y"))
    met = met.where(first & (size["x"] > 0) & (size["y"] > 0)).withColumn("share", size["x"] * size["y"] / area())
    return met.drop("__x", "__y", *(f"__{c}" for c in BOX))


def template_reads(lines: DataFrame, types: DataFrame, boxes: DataFrame, inside: float = INSIDE) -> DataFrame:
    """doc_id, document_type, name, value, confidence, seq: of each template field the surest line that stands in it, cleaned.

    lines: doc_id, line_no, text, confidence and the box; types: doc_id, document_type, a row for each type that a document may be;
    boxes: as ``templates``. Of equally sure lines the one with more of its box inside, then the first. Values that are
    empty after cleaning are no reads.
    """
    held = lines.select("doc_id", "line_no", F.trim("text").alias("value"), F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence"), *BOX)
    met = box_join(held.where("value <> ''").join(types.select("doc_id", "document_type"), "doc_id"), F.broadcast(boxes), ["document_type"])
    order = F.struct("confidence", F.round("share", 9).alias("share"), (-F.col("line_no")).alias("first"))
    best = met.where(F.round(F.col("share"), 9) >= inside).groupBy("doc_id", "document_type", "name", "seq").agg(F.max_by(F.struct("value", "confidence"), order).alias("b"))
    return intake.clean_fields(best.select("doc_id", "document_type", "name", "seq", "b.value", "b.confidence")).where("value <> ''").select("doc_id", "document_type", "name", "value", "confidence", "seq")
