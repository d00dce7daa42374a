"""Layout labels in the place of all text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import LABELS, LANGUAGES


def label(name: Column, language: str, **values: Column) -> Column:
    """The label's template with its numbers put in."""
    at = LANGUAGES.index(language) if language in LANGUAGES else 0
    text = F.create_map(*(F.lit(x) for k, v in LABELS.items() for x in (k, v[at])))[name]
    for key, value in values.items():
        text = F.replace(text, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return text


def _running(condition: Column, order: Window) -> Column:
    return F.sum(condition.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")


def word_labels(elements: DataFrame, language: str = "es") -> DataFrame:
    """Adds class and label to elements (doc_id, seq, part, style, has_num, table_row, table_col, text).

    part: body, table, textbox, header or footer; blank elements go.  Counters
    run in the order body, tables, text boxes, header, footer.
    """
    rows = elements.where(F.col("text").rlike(r"(?U)\S"))
    style = F.translate(F.lower(F.coalesce("style", F.lit(""))), " -", "")
    body = F.col("part") == "body"
    top = body & (style.rlike("heading1") | (style == "title"))
    order = Window.partitionBy("doc_id").orderBy("__part__", "seq")
    rows = rows.withColumn("__part__", F.array_position(F.array(*map(F.lit, ["body", "table", "textbox", "header", "footer"])), F.col("part")))
    rows = rows.withColumn("__top__", F.when(top, _running(top, order)))
    kind = (
        F.when(F.col("part") == "table", "table_cell_word").when(F.col("part") == "textbox", "text_box").when(F.col("part") == "header", "header").when(F.col("part") == "footer", "footer")
        .when(F.col("__top__") == 1, "doc_title").when(top, "section_title").when(style.rlike("heading2"), "section_title")
        .when(style.rlike("heading3|subtitle"), "subtitle").when(style.rlike("heading"), "section_title")
        .when(style.rlike("list") | F.coalesce(F.col("has_num"), F.lit(False)), "list_item").otherwise("paragraph")
    )
    rows = rows.withColumn("class", kind)
    counts = {c: _running(F.col("class") == c, order) for c in ("section_title", "subtitle", "paragraph", "list_item", "text_box")}
    rows = rows.withColumns({f"__n_{c}__": v for c, v in counts.items()})
    n = F.create_map(*(x for c in counts for x in (F.lit(c), F.col(f"__n_{c}__"))))[F.col("class")]
    s = F.greatest(F.col("__n_section_title__"), F.lit(1))
    out = rows.withColumn("label", label(F.col("class"), language, n=n, s=s, r=F.col("table_row"), c=F.col("table_col")))
    return out.drop("__part__", "__top__", *(f"__n_{c}__" for c in counts))


def slide_labels(shapes: DataFrame, language: str = "es") -> DataFrame:
    """Adds class and label to shapes (doc_id, slide, seq, kind, placeholder, name, table_row, table_col, text).

    kind: shape, table or note.  A placeholder's number 0 is the title, 1 the
    subtitle, others body text; the body counter also counts subtitles.
    """
    rows = shapes.where(F.col("text").rlike(r"(?U)\S"))
    holder, name = F.col("placeholder"), F.lower(F.coalesce("name", F.lit("")))
    kind = (
        F.when(F.col("kind") == "table", "table_cell_pptx").when(F.col("kind") == "note", "presenter_note").when(holder == 0, "slide_title").when(holder == 1, "slide_subtitle")
        .when(holder.isNotNull(), "body_text").when(name.rlike("footer|pie"), "slide_footer").otherwise("shape_label")
    )
    order = Window.partitionBy("doc_id").orderBy("slide", "seq")
    rows = rows.withColumn("class", kind)
    rows = rows.withColumn("__body__", _running(F.col("class").isin("body_text", "slide_subtitle"), order)).withColumn("__shape__", _running(F.col("class") == "shape_label", order))
    n = F.when(F.col("class") == "body_text", F.col("__body__")).when(F.col("class") == "shape_label", F.col("__shape__")).otherwise(F.col("slide"))
    return rows.withColumn("label", label(F.col("class"), language, n=n, s=F.col("slide"), r=F.col("table_row"), c=F.col("table_col"))).drop("__body__", "__shape__")


def cell_labels(cells: DataFrame, language: str = "es") -> DataFrame:
    """Adds class and label to cells (doc_id, sheet_ord, row, col, dtype, s, d); counters run across sheets."""
    formula = (F.col("dtype") == "f") | F.coalesce(F.col("s").startswith("="), F.lit(False))
    kind = F.when(formula, "formula").when(F.col("row") == 1, "header_col").when(F.col("dtype").isin("n", "b"), "numeric_value").otherwise("data_cell")
    order = Window.partitionBy("doc_id").orderBy("sheet_ord", "row", "col")
    rows = cells.withColumn("class", kind)
    rows = rows.withColumn("__f__", _running(F.col("class") == "formula", order)).withColumn("__v__", _running(F.col("class") == "numeric_value", order))
    n = F.when(F.col("class") == "formula", F.col("__f__")).when(F.col("class") == "numeric_value", F.col("__v__")).otherwise(F.col("col"))
    return rows.withColumn("label", label(F.col("class"), language, n=n, r=F.col("row"), c=F.col("col"))).drop("__f__", "__v__")


def ordinal_labels(rows: DataFrame, name: str, order_by: list[str], language: str = "es") -> DataFrame:
    """Labels of sheets (sheet_name) and charts (chart_title): the n-th of its document."""
    order = Window.partitionBy("doc_id").orderBy(*order_by)
    return rows.withColumn("label", label(F.lit(name), language, n=F.row_number().over(order)))


def estimated_lines(length: Column, half_points: Column) -> Column:
    """Lines that so many characters take at this font size, one at least."""
    size = F.coalesce(half_points, F.lit(24)) / 2
    return F.greatest(F.lit(1), F.ceil(length / (80 * 12 / size))).cast("long")


def extra_breaks(old: Column, new: Column, half_points: Column) -> Column:
    """Line breaks that keep a paragraph's height when its text is replaced."""
    return F.greatest(F.lit(0), estimated_lines(F.length(old), half_points) - estimated_lines(F.length(new), half_points)).cast("long")


def label_stats(labelled: DataFrame, order_by: list[str]) -> DataFrame:
    """doc_id, total, labels (distinct, in order of first use)."""
    first = labelled.groupBy("doc_id", "label").agg(F.min(F.struct(*order_by)).alias("at"), F.count("*").alias("n"))
    return first.groupBy("doc_id").agg(F.sum("n").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"))
