"""Office files in, edited files out: redaction or layout labels, with statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import CONTEXT_CARRY, MARKER, MODES, language_of, level_of
from ..functions.text import sheet_title
from ..operators import structure, tabular, units
from ..operators.language import AUTHOR
from ..sources.ooxml import EDIT, edit_files, file_units, office_files, output_name
from .anonymize import Anonymizer

_BLANK = r"^(?U)\s*$"


@dataclass(frozen=True)
class Processed:
    """``files`` (path, with the output's name, and content), ``stats`` (one row for each file) and ``faults`` (path, corrupt)."""

    files: DataFrame
    stats: DataFrame
    faults: DataFrame


def _edit(what: Column, text: Column, item: Column | None = None, name: Column | None = None, breaks: Column | None = None, part: str = "part") -> Column:
    none = F.lit(None)
    return F.struct(
        F.col(part).alias("part"), what.alias("what"), (none if item is None else item).cast("int").alias("item"), (none if name is None else name).cast("string").alias("name"),
        text.cast("string").alias("text"), (none if breaks is None else breaks).cast("int").alias("breaks"),
    )


def _collected(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.collect_list("edit").cast(EDIT).alias("edits"))


def with_contexts(rows: DataFrame) -> DataFrame:
    """Rows that hold text, with their context: the paragraph before in a Word file, the column's header in a sheet, else none."""
    cells = rows.where("area = 'cell'").select(F.col("path").alias("doc_id"), "sheet_ord", "row", "col", "dtype", F.col("text").alias("s"), "d")
    heads = units.with_headers(cells).select(F.col("doc_id").alias("hp"), F.col("sheet_ord").alias("hs"), F.col("row").alias("hr"), F.col("col").alias("hc"), "header", "is_header")
    same = (F.col("path") == F.col("hp")) & (F.col("sheet_ord") == F.col("hs")) & (F.col("row") == F.col("hr")) & (F.col("col") == F.col("hc")) & (F.col("area") == "cell")
    rows = rows.join(heads, same, "left").drop("hp", "hs", "hr", "hc")
    word = F.col("area").isin("body", "textbox", "header", "footer") | ((F.col("area") == "table") & F.col("slide").isNull())
    kind = F.col("area") != "cell"
    texts = rows.where("corrupt is null").where(F.coalesce(~F.col("text").rlike(_BLANK), F.lit(False)) & (kind | (F.col("dtype") == "s") & ~F.col("text").startswith("=")))
    before = F.lag(F.substring("text", 1, CONTEXT_CARRY)).over(Window.partitionBy("path", word).orderBy("unit_seq"))
    return texts.withColumn("context", F.when(word, F.coalesce(before, F.lit(""))).otherwise(F.coalesce("header", F.lit(""))))


def redact_files(files: DataFrame, anonymizer: Anonymizer | None = None) -> Processed:
    """Redacts Office files (path, content): text with markers, sensitive numbers, sheet and chart titles, and metadata.

    Authors count as persons and are looked for in the text as well; values that
    are markers already stay.  A sheet that some formula refers to keeps its
    title, with the warning ``sheet_not_renamed``.  Files that cannot be read
    come out in ``faults`` alone: an unredacted file is never handed on.
    """
    anonymizer = anonymizer or Anonymizer()
    rows = file_units(files).persist()
    texts = with_contexts(rows).withColumn("doc_id", F.col("path"))
    marked = F.col("text").rlike(f"^(?:{MARKER})$")
    authors = texts.where((F.col("area") == "author") & ~marked).select("doc_id", "unit_seq", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(AUTHOR).alias("label"), "text")
    names = authors if anonymizer.names is None else anonymizer.names.select(*authors.columns).unionByName(authors)
    said = anonymizer.warnings if anonymizer.names is not None else ({"code": "recogniser_missing"},)
    own = replace(anonymizer, names=names, warnings=tuple(said))
    done = own.transform(texts.withColumn("segments", F.coalesce("segments", F.array().cast("array<string>")))).where(F.col("replaced") > 0).persist()
    nodes = done.where(F.size("nodes") > 0).select("path", "part", F.explode(F.arrays_zip(F.col("nodes").alias("item"), F.col("redacted_segments").alias("text"))).alias("x"))
    edits = nodes.select("path", _edit(F.lit("node"), F.col("x.text"), F.col("x.item")).alias("edit"))
    edits = edits.unionByName(done.where("area = 'cell'").select("path", _edit(F.lit("cell"), F.col("redacted"), F.col("item")).alias("edit")))
    edits = edits.unionByName(done.where(F.col("area").isin("author", "property")).select("path", _edit(F.lit("property"), F.col("redacted"), name=F.col("name")).alias("edit")))
    cells = rows.where("area = 'cell'").select(F.col("path").alias("doc_id"), "part", "item", "sheet_ord", "row", "col", "dtype", F.col("text").alias("s"), "d")
    numbers = tabular.number_markers(units.with_headers(cells), level_of(own.level), own.language)
    edits = edits.unionByName(numbers.select(F.col("doc_id").alias("path"), _edit(F.lit("cell"), F.col("marker"), F.col("item")).alias("edit")))
    titles = done.where("area = 'sheet'").select("doc_id", "part", "item", "sheet_ord", F.col("text").alias("title"), sheet_title(F.col("redacted")).alias("new_title"))
    renamed = tabular.renameable_sheets(titles, cells)
    edits = edits.unionByName(renamed.select(F.col("doc_id").alias("path"), _edit(F.lit("sheet"), F.col("new_title"), F.col("item")).alias("edit")))
    faults = rows.where("corrupt is not null").select("path", "corrupt")
    whole = files.join(faults.select(F.col("path").alias("fp")), F.col("path") == F.col("fp"), "left_anti")
    per = lambda df, name: df.groupBy(F.col("doc_id").alias("k")).agg(F.count("*").alias(name))
    metadata, kept = done.where(F.col("area").isin("author", "property")), titles.join(renamed.select(F.col("doc_id").alias("rd"), F.col("sheet_ord").alias("rs")), (F.col("doc_id") == F.col("rd")) & (F.col("sheet_ord") == F.col("rs")), "left_anti")
    stats = own.stats(texts).withColumn("engine", F.lit(anonymizer.engine)).withColumnRenamed("doc_id", "path")
    for table, name in ((per(numbers, "numeric_cells"), "numeric_cells"), (per(metadata, "metadata_cleaned"), "metadata_cleaned"), (per(kept, "sheets_kept"), "sheets_kept")):
        stats = stats.join(table, F.col("path") == F.col("k"), "left").drop("k").withColumn(name, F.coalesce(name, F.lit(0)))
    warning = F.array(F.create_map(F.lit("code"), F.lit("sheet_not_renamed"), F.lit("count"), F.col("sheets_kept").cast("string")))
    stats = stats.withColumn("warnings", F.when(F.col("sheets_kept") > 0, F.concat("warnings", warning)).otherwise(F.col("warnings"))).withColumn("total", F.col("total_distinct") + F.col("numeric_cells"))
    return Processed(edit_files(whole, _collected(edits)).withColumn("path", output_name(F.col("path"), "pii")), stats, faults)


def label_files(files: DataFrame, language: str = "es") -> Processed:
    """Puts layout labels in the place of all text of Office files (path, content).

    A paragraph's label stands in its first text node, with line breaks that
    keep its height; a shape keeps its first paragraph only.
    """
    language = language_of(language)
    rows = file_units(files).persist()
    word = rows.where(F.col("slide").isNull() & F.col("area").isin("body", "table", "textbox", "header", "footer")).select("*", F.col("path").alias("doc_id"), F.col("unit_seq").alias("seq"))
    word = structure.word_labels(word.withColumn("part_of", F.col("part")).withColumn("part", F.col("area")), language).withColumn("part", F.col("part_of"))
    breaks = structure.extra_breaks(F.col("text"), F.col("label"), F.col("half_points"))
    put = lambda k, breaks=None: F.transform("nodes", lambda n, i: _edit(F.lit("node"), F.when(F.lit(k) & (i == 0), F.col("label")).otherwise(""), n, breaks=None if breaks is None else F.when(i == 0, breaks)))
    edits = [word.where(F.size("nodes") > 0).select("path", F.explode(put(True, breaks)).alias("edit"))]
    slides = rows.where(F.col("slide").isNotNull())
    shapes = slides.groupBy(F.col("path").alias("doc_id"), "slide", "shape").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_seq", "text"))), lambda x: x["text"]), "\n").alias("text"), F.first("area").alias("kind"), F.first("placeholder").alias("placeholder"),
        F.first("name").alias("name"), F.first("table_row").alias("table_row"), F.first("table_col").alias("table_col"), F.min("unit_seq").alias("seq"),
    )
    shapes = structure.slide_labels(shapes, language)
    labelled = shapes.select(F.col("doc_id").alias("sp"), F.col("shape").alias("ss"), "label", F.col("seq").alias("first"))
    # the label goes to the first paragraph that has a text node; paragraphs behind it go
    own = slides.join(labelled, (F.col("path") == F.col("sp")) & (F.col("shape") == F.col("ss")))
    at = F.min(F.when(F.size("nodes") > 0, F.col("unit_seq"))).over(Window.partitionBy("path", "shape"))
    own = own.withColumn("holder", at)
    edits.append(own.where(F.col("unit_seq") == F.col("holder")).select("path", F.explode(put(True)).alias("edit")))
    edits.append(own.where(F.col("unit_seq") != F.col("holder")).select("path", _edit(F.lit("paragraph"), F.lit(None), F.col("item")).alias("edit")))
    cells = rows.where("area = 'cell'").select(F.col("path").alias("doc_id"), "part", "item", "sheet_ord", "row", "col", "dtype", F.col("text").alias("s"), "d")
    cells = structure.cell_labels(cells, language)
    edits.append(cells.select(F.col("doc_id").alias("path"), _edit(F.lit("cell"), F.col("label"), F.col("item")).alias("edit")))
    sheets = structure.ordinal_labels(rows.where("area = 'sheet'").withColumn("doc_id", F.col("path")), "sheet_name", ["sheet_ord"], language)
    edits.append(sheets.select("path", _edit(F.lit("sheet"), F.substring("label", 1, 31), F.col("item")).alias("edit")))
    charts = structure.ordinal_labels(rows.where("area = 'chart'").withColumn("doc_id", F.col("path")), "chart_title", ["sheet_ord", "unit_seq"], language)
    edits.append(charts.where(F.size("nodes") > 0).select("path", F.explode(put(True)).alias("edit")))
    every = edits[0]
    for more in edits[1:]:
        every = every.unionByName(more)
    # in the order in which labels are given: sheet by sheet its title, cells and charts; else by place
    place = lambda table, step, seq: table.select("doc_id", "label", F.coalesce("sheet_ord", F.lit(0)).alias("a"), F.lit(step).alias("b"), F.col(seq).cast("long").alias("c"))
    parts = F.array_position(F.array(*map(F.lit, ["body", "table", "textbox", "header", "footer"])), F.col("area")).cast("int")
    given = place(sheets, 0, "unit_seq").unionByName(place(cells, 1, "item")).unionByName(place(charts, 2, "unit_seq"))
    given = given.unionByName(word.select("doc_id", "label", F.lit(0).alias("a"), parts.alias("b"), F.col("seq").cast("long").alias("c")))
    given = given.unionByName(shapes.select("doc_id", "label", F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("seq").cast("long").alias("c")))
    stats = structure.label_stats(given, ["a", "b", "c"]).withColumnRenamed("doc_id", "path")
    faults = rows.where("corrupt is not null").select("path", "corrupt")
    whole = files.join(faults.select(F.col("path").alias("fp")), F.col("path") == F.col("fp"), "left_anti")
    return Processed(edit_files(whole, _collected(every)).withColumn("path", output_name(F.col("path"), "structure")), stats, faults)


def process_path(spark: SparkSession, path: str, mode: str = "structure", level: str = "balanced", language: str = "es", **options) -> Processed:
    """The Office files under ``path``, redacted (mode pii) or labelled (mode structure).

    An unknown mode, or a single file of another kind, is a ValueError; an
    unknown level counts as balanced, an unknown language as es.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name:
        from ..sources.ooxml import extension

        extension(name)
    files = office_files(spark, path)
    return label_files(files, language) if mode == "structure" else redact_files(files, Anonymizer(level, language_of(language), **options))
