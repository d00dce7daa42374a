"""Text units: from documents, with the context of their neighbours or column headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import CONTEXT_CARRY, HEADER_ROWS
from ..functions.text import once


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, unit_seq, text: the lines of each document that are not blank."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("unit_seq", "text"))
    return lines.where(F.col("text").rlike(r"(?U)\S"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores if it is read from fewer files than there are cores; else as it is.

    A file of one row group is read by one task, however large it is.  With many
    files this adds no shuffle.  Files are counted in the JVM; no path comes here.
    """
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df._jdf.inputFiles())
    return df.repartition(4 * cores) if 0 < files < cores else df


def row_units(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``u``: the lines of the row's text that are not blank (unit_seq, text, context)."""
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(i.alias("unit_seq"), x.alias("text")))
    rows = rows.withColumn("__u__", once(F.filter(lines, lambda u: u["text"].rlike(r"(?U)\S"))))
    before = lambda i: F.coalesce(F.substring(F.get("__u__", i - 1)["text"], 1, CONTEXT_CARRY), F.lit(""))
    units = F.transform("__u__", lambda u, i: F.struct(u["unit_seq"].alias("unit_seq"), u["text"].alias("text"), before(i).alias("context")))
    return rows.withColumn("u", once(units)).drop("__u__")


def document_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``with_previous(split_lines(docs))``, but within each row: no shuffle, and detection stays as parallel as the scan."""
    rows = row_units(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select("doc_id", F.explode("u").alias("e")).select("doc_id", "e.unit_seq", "e.text", "e.context")


def with_previous(units: DataFrame) -> DataFrame:
    """Adds context: the first characters of the unit before."""
    order = Window.partitionBy("doc_id").orderBy("unit_seq")
    return units.withColumn("context", F.coalesce(F.lag(F.substring("text", 1, CONTEXT_CARRY)).over(order), F.lit("")))


def distinct_units(units: DataFrame) -> DataFrame:
    """One row for each (doc_id, text, context), at its first place, and how often it occurs."""
    return units.groupBy("doc_id", "text", "context").agg(F.min("unit_seq").alias("unit_seq"), F.count("*").alias("times"))


def is_formula(cells: DataFrame) -> DataFrame:
    return cells.withColumn("is_formula", (F.col("dtype") == "f") | F.coalesce(F.col("s").startswith("="), F.lit(False)))


def header_rows(cells: DataFrame) -> DataFrame:
    """Per sheet, the first of the first rows with three texts at least and no number.

    cells: doc_id, sheet_ord, row, col, dtype (s text, n number, b boolean, f formula), s, d.
    """
    text = (F.col("dtype") == "s") & F.col("s").rlike(r"(?U)\S") & ~F.col("s").startswith("=")
    counts = cells.where(F.col("row") <= HEADER_ROWS).groupBy("doc_id", "sheet_ord", "row").agg(F.count_if(text).alias("texts"), F.count_if(F.col("dtype") == "n").alias("numbers"))
    return counts.where("texts >= 3 and numbers = 0").groupBy("doc_id", "sheet_ord").agg(F.min("row").alias("header_row"))


def with_headers(cells: DataFrame) -> DataFrame:
    """Adds header (the stripped text of the column's header cell, or empty) and is_header."""
    found = header_rows(cells)
    keyed = cells.join(found, ["doc_id", "sheet_ord"], "left")
    heads = keyed.where((F.col("row") == F.col("header_row")) & (F.col("dtype") == "s")).select("doc_id", "sheet_ord", "col", F.trim("s").alias("header"))
    out = keyed.join(heads, ["doc_id", "sheet_ord", "col"], "left")
    is_header = F.coalesce(F.col("row") == F.col("header_row"), F.lit(False))
    return out.withColumn("is_header", is_header).withColumn("header", F.when(is_header, "").otherwise(F.coalesce("header", F.lit("")))).drop("header_row")


def cell_units(cells: DataFrame) -> DataFrame:
    """Text cells with their header as context, in reading order.  Formulas are passed over."""
    texts = with_headers(cells).where((F.col("dtype") == "s") & F.col("s").rlike(r"(?U)\S") & ~F.col("s").startswith("="))
    order = Window.partitionBy("doc_id").orderBy("sheet_ord", "row", "col")
    return texts.select("doc_id", (F.row_number().over(order) - 1).alias("unit_seq"), F.col("s").alias("text"), F.col("header").alias("context"), "sheet_ord", "row", "col")
