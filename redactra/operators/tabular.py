"""Worksheets: which numbers are sensitive, and their markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import BALANCED, FULL, SENSITIVE_HEADER
from ..functions.text import marker


def sensitive_header(header: Column) -> Column:
    return F.coalesce(header, F.lit("")).rlike("(?iU)" + SENSITIVE_HEADER)


def is_masked_number(level: int, dtype: Column, header: Column, is_header: Column) -> Column:
    """Numbers never at the soft level, under a sensitive header at the balanced one, always at the full one."""
    number = (dtype == "n") & ~is_header
    return number if level >= FULL else number & sensitive_header(header) if level == BALANCED else F.lit(False)


def number_markers(cells: DataFrame, level: int, language: str = "es") -> DataFrame:
    """Masked number cells (doc_id, sheet_ord, row, col) with n and marker, numbered in reading order; each cell is an entity.

    cells: as :func:`redactra.operators.units.with_headers` returns them.
    """
    masked = cells.where(is_masked_number(level, F.col("dtype"), F.col("header"), F.col("is_header")))
    order = Window.partitionBy("doc_id").orderBy("sheet_ord", "row", "col")
    numbered = masked.withColumn("n", F.row_number().over(order))
    return numbered.withColumn("marker", marker(F.lit("NUMBER"), F.col("n"), language))


def renameable_sheets(titles: DataFrame, cells: DataFrame) -> DataFrame:
    """Titles (doc_id, sheet_ord, title, new_title) that changed and that no formula refers to."""
    formulas = cells.where((F.col("dtype") == "f") | F.col("s").startswith("=")).select(F.col("doc_id").alias("fd"), F.col("s").alias("formula"))
    changed = titles.where(F.col("title") != F.col("new_title"))
    # the title or the quoted title, blanks, an exclamation mark; the title is quoted for the expression
    plain = F.concat(F.lit("\\Q"), F.replace("title", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    refers = F.rlike(F.col("formula"), F.concat(F.lit("(?:'"), plain, F.lit("'|"), plain, F.lit(r")\s*!")))
    return changed.join(formulas, (F.col("doc_id") == F.col("fd")) & refers, "left_anti")
