"""Reading order of a page's lines: rows by their overlap, and two columns where a page plainly has them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Fixed values of the layout test.
ROW_OVERLAP = 0.5
COLUMN_GAP = 30.0
LEAST_LINES = 3
LEAST_REPEATS = 2
LEAST_SHARED_HEIGHT = 0.3
MIDDLE = (0.25, 0.75)
MARGIN = 0.12
LEAST_PAGES = 3
LEAST_LENGTH = 4


def column_splits(lines: DataFrame, page: Sequence[str], width: str | None = None) -> DataFrame:
    """page, split: where a page's lines part into two columns; no row for other pages.

    A split is a gap of COLUMN_GAP or more between line starts that occur LEAST_REPEATS times, in the middle of the
    page if its ``width`` is known, with LEAST_LINES lines on each side, whose heights share LEAST_SHARED_HEIGHT of
    the lower side's. The widest gap counts, then the leftmost.
    """
    starts = lines.groupBy(*page, "x0").agg(F.count(F.lit(1)).alias("_n"), *([F.max(width).alias("_width")] if width else [])).filter(F.col("_n") >= LEAST_REPEATS)
    gap = F.col("x0") - F.lag("x0").over(Window.partitionBy(*page).orderBy("x0"))
    gaps = starts.withColumn("_gap", gap).filter(F.col("_gap") >= COLUMN_GAP)
    if width:
        gaps = gaps.filter(((F.col("x0") - F.col("_gap") / 2) / F.col("_width")).between(*MIDDLE))
    sides = lines.join(gaps.select(*page, (F.col("x0") - F.col("_gap") / 2).alias("split"), "_gap"), list(page)).groupBy(*page, "split", "_gap")
    left = F.col("x0") < F.col("split")
    told = sides.agg(
        F.count_if(left).alias("a"), F.count_if(~left).alias("b"), *[f(F.when(on, F.col(y))).alias(n) for on, k in ((left, "a"), (~left, "b")) for f, y, n in ((F.min, "y0", f"{k}0"), (F.max, "y1", f"{k}1"))],
    )
    shared = F.least("a1", "b1") - F.greatest("a0", "b0")
    good = told.filter((F.col("a") >= LEAST_LINES) & (F.col("b") >= LEAST_LINES)).filter(shared >= LEAST_SHARED_HEIGHT * F.least(F.expr("a1 - a0"), F.expr("b1 - b0")))
    return good.groupBy(*page).agg(F.min_by("split", F.struct((-F.col("_gap")).alias("gap"), "split")).alias("split"))


def reading_order(lines: DataFrame, page: Sequence[str], tie: Sequence[str], columns: bool = False, width: str | None = None) -> DataFrame:
    """The lines (``x0``, ``y0``, ``y1``) with ``column`` (0, or 1 for the right one), ``row`` and ``place`` on their page, from 0.

    From top to bottom a line joins the row before it if their heights overlap by ROW_OVERLAP of the lowest line of
    both; a row is read from left to right. Lines are sorted by the shuffle and streamed; a task keeps three numbers of
    the row that is open, so a page of any length is one pass. ``tie`` orders lines of one place.
    """
    side = F.lit(0)
    if columns:
        lines = lines.join(column_splits(lines, page, width), list(page), "left")
        side = F.when(F.col("x0") >= F.col("split"), 1).otherwise(0)
    lines = lines.withColumn("column", side.cast("int")).drop("split")
    keys = [*page, "column"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, row, top, bottom, low = None, 0, 0.0, 0.0, 0.0
        for batch in batches:
            placed = []
            for *key, y0, y1 in batch[[*keys, "y0", "y1"]].itertuples(index=False, name=None):
                height = y1 - y0
                if key != at:
                    at, row, top, bottom, low = key, 0, y0, y1, height
                else:
                    shortest = min(height, low)
                    if shortest > 0 and (min(y1, bottom) - max(y0, top)) / shortest >= ROW_OVERLAP:
                        bottom, low = max(bottom, y1), shortest
                    else:
                        row, top, bottom, low = row + 1, y0, y1, height
                placed.append(row)
            yield batch.assign(row=placed)

    schema = StructType([*lines.schema.fields, StructField("row", IntegerType())])
    found = lines.repartition(*page).sortWithinPartitions(*keys, "y0", "x0", *tie).mapInPandas(rows, schema)
    order = Window.partitionBy(*page).orderBy("column", "row", "x0", "y0", *tie)
    return found.withColumn("place", F.row_number().over(order) - 1)


def running_lines(lines: DataFrame, doc: Sequence[str], page: str, text: str, height: str) -> DataFrame:
    """doc, text: what stands in the upper or lower margin of LEAST_PAGES pages of a document or more, word for word."""
    margin = (F.col("y1") <= F.col(height) * MARGIN) | (F.col("y0") >= F.col(height) * (1 - MARGIN))
    hits = lines.filter(margin & (F.length(text) >= LEAST_LENGTH)).select(*doc, text, page).distinct()
    return hits.groupBy(*doc, text).agg(F.count(F.lit(1)).alias("_pages")).filter(F.col("_pages") >= LEAST_PAGES).drop("_pages")


def page_structure(lines: DataFrame, doc: Sequence[str], page: str, text: str, tie: Sequence[str], height: str, columns: bool = False, width: str | None = None) -> DataFrame:
    """``reading_order`` of each page without running heads and feet. A line whose text is one goes wherever it stands; a null text stays."""
    kept = lines.join(running_lines(lines, doc, page, text, height), [*doc, text], "left_anti").select(*lines.columns)
    return reading_order(kept, [*doc, page], tie, columns, width)
