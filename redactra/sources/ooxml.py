"""Office packages: readers to units, elements, shapes and cells, and a writer that edits text nodes in place.

Only the standard library is used.  A package that cannot be read gives one row
with its fault in ``corrupt`` instead of stopping the job.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
#: One row for each paragraph, cell, title or property: where it is (``part``, and ``nodes``, the ordinals of its text nodes there, or ``item``, the ordinal of
#: its paragraph, cell or sheet), what it holds, and what labels need to know.
UNIT = (
    "path string, unit_seq int, area string, part string, nodes array<int>, item int, segments array<string>, text string, style string, has_num boolean, table_row int, table_col int, "
    "half_points int, slide int, shape int, placeholder int, name string, sheet_ord int, row int, col int, dtype string, d double, corrupt string"
)
FIELDS = [c.split()[0] for c in UNIT.split(", ")]
#: Core properties that hold text; the first two name people.
AUTHORS, PROPERTIES = ("creator", "lastModifiedBy"), ("title", "subject", "description", "keywords", "category", "Company")
EXTENSIONS = ("docx", "pptx", "xlsx")


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Targets and kinds of a part's relationships by their id."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{folder}/{t}")
    found = ET.fromstring(z.read(rels))
    return {r.get("Id"): (place(r.get("Target", "")), r.get("Type", "").rsplit("/", 1)[-1]) for r in found if r.get("TargetMode") != "External"}


def _own_nodes(paragraph: ET.Element, run: str, text: str, inner: str) -> list[ET.Element]:
    """Text nodes of the paragraph's runs, links included, but not those of paragraphs inside it."""
    out: list[ET.Element] = []

    def walk(node: ET.Element) -> None:
        for child in node:
            if child.tag == inner:
                continue
            if child.tag == text and node.tag == run:
                out.append(child)
            walk(child)

    walk(paragraph)
    return out


def _paragraph(paragraph: ET.Element, order: dict[ET.Element, int], space: str) -> dict:
    nodes = _own_nodes(paragraph, space + "r", space + "t", space + "p")
    segments = [t.text or "" for t in nodes]
    return {"nodes": [order[t] for t in nodes], "segments": segments, "text": "".join(segments)}


def _order(root: ET.Element) -> dict[ET.Element, int]:
    return {t: k for k, t in enumerate(t for t in root.iter() if t.tag in (W + "t", A + "t"))}


def word_parts(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """The document, then headers and footers in the order in which sections refer to them, each once."""
    yield "word/document.xml", "body"
    relations, seen = _relations(z, "word/document.xml"), set()
    for kind in ("header", "footer"):
        for reference in ET.fromstring(z.read("word/document.xml")).iter(f"{W}{kind}Reference"):
            part = relations.get(reference.get(R + "id"), ("", ""))[0]
            if part in z.namelist() and part not in seen:
                seen.add(part)
                yield part, kind


def read_word(z: zipfile.ZipFile) -> Iterator[dict]:
    for part, area in word_parts(z):
        root = ET.fromstring(z.read(part))
        order = _order(root)
        place = {p: ("textbox", None, None) for box in root.iter(W + "txbxContent") for p in box.iter(W + "p")}
        for table in root.iter(W + "tbl"):
            for r, row in enumerate(table.findall(W + "tr"), 1):
                for c, cell in enumerate(row.findall(W + "tc"), 1):
                    place |= {p: ("table", r, c) for p in cell.iter(W + "p") if p not in place}
        for p in root.iter(W + "p"):
            style, size = p.find(f"{W}pPr/{W}pStyle"), p.find(f"{W}r/{W}rPr/{W}sz")
            kind, r, c = place.get(p, (area, None, None)) if area == "body" else (area, None, None)
            yield _paragraph(p, order, W) | {
                "area": kind, "part": part, "style": style.get(W + "val") if style is not None else None, "has_num": p.find(f"{W}pPr/{W}numPr") is not None,
                "table_row": r, "table_col": c, "half_points": int(size.get(W + "val")) if size is not None else None,
            }


def read_slides(z: zipfile.ZipFile) -> Iterator[dict]:
    """Shapes in the order of the presentation's slides, groups opened, then the slide's notes."""
    relations, shapes = _relations(z, "ppt/presentation.xml"), 0
    for n, slide in enumerate(ET.fromstring(z.read("ppt/presentation.xml")).iter(P + "sldId"), 1):
        part = relations[slide.get(R + "id")][0]
        notes = [t for t, kind in _relations(z, part).values() if kind == "notesSlide" and t in z.namelist()]
        for own, area in ((part, "shape"), *((t, "note") for t in notes)):
            root = ET.fromstring(z.read(own))
            order, ordinal = _order(root), {p: k for k, p in enumerate(root.iter(A + "p"))}
            for element in root.iter():
                if element.tag not in (P + "sp", P + "graphicFrame"):
                    continue
                about, holder = element.find(f".//{P}cNvPr"), element.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                if area == "note" and (holder is None or holder.get("type") != "body"):
                    continue  # the picture of the slide, its number, the date
                frames = [(element, None, None)] if element.tag == P + "sp" else [
                    (cell, r, c) for r, row in enumerate(element.iter(A + "tr"), 1) for c, cell in enumerate(row.findall(A + "tc"), 1)
                ]
                for frame, r, c in frames:
                    shapes += 1
                    for p in frame.iter(A + "p"):
                        yield _paragraph(p, order, A) | {
                            "area": "table" if r else area, "part": own, "item": ordinal[p], "slide": n, "shape": shapes, "table_row": r, "table_col": c,
                            "placeholder": int(holder.get("idx", 0)) if holder is not None else None, "name": about.get("name") if about is not None else None,
                        }


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n


def read_workbook(z: zipfile.ZipFile) -> Iterator[dict]:
    """Cells (dtype: s text, n number, b boolean, f formula, e error, t date), then sheets' and charts' titles."""
    names, relations = z.namelist(), _relations(z, "xl/workbook.xml")
    shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(S + "si")] if "xl/sharedStrings.xml" in names else []
    titles = []
    for k, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"), 1):
        part = relations[sheet.get(R + "id")][0]
        titles.append({"area": "sheet", "part": "xl/workbook.xml", "item": k - 1, "sheet_ord": k, "text": sheet.get("name")})
        for _, drawing in ((i, t) for i, (t, kind) in _relations(z, part).items() if kind == "drawing"):
            for chart in (t for t, kind in _relations(z, drawing).values() if kind == "chart" and t in names):
                root = ET.fromstring(z.read(chart))
                order, rich = _order(root), root.find(f"{C}chart/{C}title/{C}tx/{C}rich")
                nodes = [t for t in rich.iter(A + "t")] if rich is not None else []
                titles.append({"area": "chart", "part": chart, "nodes": [order[t] for t in nodes], "segments": [t.text or "" for t in nodes], "sheet_ord": k, "text": "".join(t.text or "" for t in nodes)})
        row = at = 0
        item = 0
        for line in ET.fromstring(z.read(part)).iter(S + "row"):
            row, at = int(line.get("r", row + 1)), 0
            for cell in line.findall(S + "c"):
                at = _column(cell.get("r")) if cell.get("r") else at + 1
                kind, value, formula = cell.get("t", "n"), cell.findtext(S + "v"), cell.find(S + "f")
                base = {"area": "cell", "part": part, "item": item, "sheet_ord": k, "row": row, "col": at}
                item += 1
                if formula is not None:
                    yield base | {"dtype": "f", "text": "=" + (formula.text or "")}
                elif kind == "inlineStr":
                    yield base | {"dtype": "s", "text": "".join(t.text or "" for t in cell.iter(S + "t"))}
                elif value is not None and kind in ("s", "str", "e", "d"):
                    yield base | {"dtype": {"e": "e", "d": "t"}.get(kind, "s"), "text": shared[int(value)] if kind == "s" else value}
                elif value is not None:
                    yield base | {"dtype": "b" if kind == "b" else "n", "d": float(value)}
    yield from titles


def read_properties(z: zipfile.ZipFile) -> Iterator[dict]:
    for part in ("docProps/core.xml", "docProps/app.xml"):
        if part in z.namelist():
            for element in ET.fromstring(z.read(part)):
                name = element.tag.rsplit("}", 1)[-1]
                if name in AUTHORS + PROPERTIES and (element.text or "").strip():
                    yield {"area": "author" if name in AUTHORS else "property", "part": part, "name": name, "text": element.text}


READERS = {"docx": read_word, "pptx": read_slides, "xlsx": read_workbook}


def extension(path: str) -> str:
    found = path.rsplit(".", 1)[-1].lower()
    if found not in EXTENSIONS:
        raise ValueError(f"{path}: only {', '.join(EXTENSIONS)} can be read")
    return found


def read_package(path: str, data: bytes) -> list[dict]:
    """Rows of UNIT for a file; one that cannot be read is one row with its fault, whatever the fault."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            rows = [*READERS[extension(path)](z), *read_properties(z)]
    except Exception as fault:  # noqa: BLE001  a broken file must not stop the others
        return [{"path": path, "area": "corrupt", "corrupt": repr(fault)}]
    return [{"path": path, "unit_seq": k} | row for k, row in enumerate(rows)]


def office_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the Office files under ``path``, or of the one file."""
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,pptx,xlsx}").option("recursiveFileLookup", "true").load(path).select("path", "content")


def file_units(files: DataFrame) -> DataFrame:
    """UNIT rows of files (path, content)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = read_package(path, data)
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(FIELDS, _arrow(), strict=True)], names=FIELDS)

    return files.select("path", "content").mapInArrow(run, UNIT)


def _arrow() -> list:
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return [kinds[c.split()[1]] for c in UNIT.split(", ")]


_NODE = re.compile(rb"<(w|a):t(?: [^>]*)?(?:/>|>([^<]*)</\1:t>)")
_PARAGRAPH = re.compile(rb"<a:p(?: [^>]*)?/>|<a:p(?: [^>]*)?>.*?</a:p>", re.DOTALL)
_CELL = re.compile(rb"<c((?: [^>]*?)?)(?:/>|>.*?</c>)", re.DOTALL)
_SHEET = re.compile(rb"(<sheet [^>]*?name=)\"[^\"]*\"")
#: What an edit does: the text of a node, a node with line breaks behind it, a paragraph that goes, a cell, a sheet's title, a property.
EDIT = "array<struct<part:string,what:string,item:int,name:string,text:string,breaks:int>>"


def _counted(pattern: re.Pattern, body: bytes, new: dict[int, object], put) -> bytes:
    at = iter(range(body.count(b"<") + 1))
    return pattern.sub(lambda m: put(m, new[k]) if (k := next(at)) in new else m[0], body)


def _node(m: re.Match, edit: dict) -> bytes:
    space = b' xml:space="preserve"' if m[1] == b"w" else b""
    broken = b"<w:br/>" * (edit["breaks"] or 0) if m[1] == b"w" else b""
    return b"<%s:t%s>%s</%s:t>" % (m[1], space, escape(edit["text"]).encode(), m[1]) + broken


def _cell(m: re.Match, edit: dict) -> bytes:
    kept = re.sub(rb'\st="[^"]*"', b"", m[1])
    return b'<c%s t="inlineStr"><is><t xml:space="preserve">%s</t></is></c>' % (kept, escape(edit["text"]).encode())


def edit_package(data: bytes, edits: list[dict]) -> bytes:
    """The package with the edits (see EDIT) made in its parts; all other bytes stay."""
    by_part: dict[str, dict[str, dict]] = {}
    for e in edits:
        by_part.setdefault(e["part"], {}).setdefault(e["what"], {})[e["name"] if e["what"] == "property" else e["item"]] = e
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for info in z.infolist():
            body, own = z.read(info.filename), by_part.get(info.filename, {})
            body = _counted(_NODE, body, own.get("node", {}), _node)
            body = _counted(_PARAGRAPH, body, own.get("paragraph", {}), lambda m, e: b"")
            body = _counted(_CELL, body, own.get("cell", {}), _cell)
            body = _counted(_SHEET, body, own.get("sheet", {}), lambda m, e: m[1] + b'"' + escape(e["text"], {'"': "&quot;"}).encode() + b'"')
            for name, e in own.get("property", {}).items():
                body = re.sub(rb"(<(?:\w+:)?%s(?: [^>]*)?>)[^<]*(</)" % name.encode(), lambda m, v=e["text"]: m[1] + escape(v).encode() + m[2], body)
            target.writestr(info, body)
    return out.getvalue()


def node_texts(data: bytes, part: str) -> list[str]:
    """Texts of a part's nodes in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [t.text or "" for t in _order(ET.fromstring(z.read(part)))]


def edit_files(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path and content of all files, with the edits (path, edits: EDIT) made; a file without any stays as it is."""
    rows = files.join(edits.select(F.col("path").alias("__p__"), "edits"), F.col("path") == F.col("__p__"), "left").select("path", "content", "edits")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, data, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([edit_package(data, own) if own else data], pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes files (path, content) under ``folder``, which all executors share, by their own names; returns path and bytes.

    A file is written under a name of the attempt and renamed, so a task that runs again replaces the same content.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1]
                trial = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(trial) as out:
                    out.write(data)
                store.move(trial, f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(data)], pa.int64())], names=["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")


def output_name(path, mode: str):
    """``report.docx`` → ``report_anonymized.docx`` (or ``_structure``), as a Column."""
    ending = "_structure" if mode == "structure" else "_anonymized"
    return F.regexp_replace(path, r"(\.[^./]+)$", ending + "$1")
