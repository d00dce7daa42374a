"""Office files built in memory: read, redacted or labelled, written and read again."""

import io
import zipfile

import pytest

from redactra.plans.anonymize import Anonymizer
from redactra.plans.files import label_files, process_path, redact_files
from redactra.sources import ooxml

NS = {k: getattr(ooxml, k)[1:-1] for k in "WAPSRC"}
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def rels(*targets):
    return "<Relationships>" + "".join(f'<Relationship Id="r{k}" Type="{REL}/{kind}" Target="{t}"/>' for k, (kind, t) in enumerate(targets, 1)) + "</Relationships>"


CORE = '<cp:p xmlns:cp="c" xmlns:dc="d"><dc:creator>Ana Soto</dc:creator><dc:title>Mail a@x.org</dc:title><dc:subject>plain</dc:subject><cp:lastModifiedBy>[NAME_7]</cp:lastModifiedBy></cp:p>'


def word():
    p = lambda *runs, style="", more="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}{''.join(f'<w:r><w:t>{r}</w:t></w:r>' for r in runs)}{more}</w:p>"
    box = f"<w:r><w:txbxContent>{p('box c@x.org')}</w:txbxContent></w:r>"
    body = p("Report", style="Title") + p("Ana So", "to wrote a@", "x.org", more=box) + p("w " * 100) + f"<w:tbl><w:tr><w:tc>{p('cell')}</w:tc></w:tr></w:tbl>"
    section = f'<w:sectPr xmlns:r="{REL}"><w:footerReference r:id="r2"/><w:headerReference r:id="r1"/></w:sectPr>'
    return package({
        "word/document.xml": f'<w:document xmlns:w="{NS["W"]}"><w:body>{body}{section}</w:body></w:document>', "word/_rels/document.xml.rels": rels(("header", "header9.xml"), ("footer", "footer2.xml")),
        "word/header9.xml": f'<w:hdr xmlns:w="{NS["W"]}">{p("head a@x.org")}</w:hdr>', "word/footer2.xml": f'<w:ftr xmlns:w="{NS["W"]}">{p("foot")}</w:ftr>', "docProps/core.xml": CORE,
    })


def slides():
    sp = lambda holder, name, *ps: f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in ps)}</p:txBody></p:sp>'
    table = '<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>x1</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>b@x.org</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>'
    slide = lambda inner: f'<p:sld xmlns:p="{NS["P"]}" xmlns:a="{NS["A"]}">{inner}</p:sld>'
    return package({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{NS["P"]}" xmlns:r="{REL}"><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("slide", "slides/slide1.xml"), ("slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide("<p:grpSp>" + sp("", "Box", "second a@x.org", "more") + "</p:grpSp>" + table), "ppt/slides/_rels/slide1.xml.rels": rels(("notesSlide", "../notesSlides/notesSlide7.xml")),
        "ppt/slides/slide2.xml": slide(sp('<p:ph type="title"/>', "T", "first") + sp('<p:ph idx="1"/>', "S", "sub") + sp("", "Footer 1", "foot") + sp('<p:ph idx="5"/>', "B", "a@x.org")),
        "ppt/notesSlides/notesSlide7.xml": slide(sp('<p:ph type="sldNum" idx="10"/>', "N", "3") + sp('<p:ph type="body" idx="1"/>', "Notes", "note b@x.org")),
    })


def workbook():
    row = lambda n, *cells: f'<row r="{n}">{"".join(cells)}</row>'
    text = lambda r, v: f'<c r="{r}" s="4" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = lambda *rows, more="": f'<worksheet xmlns="{NS["S"]}"><sheetData>{"".join(rows)}</sheetData>{more}</worksheet>'
    return package({
        "xl/workbook.xml": f'<workbook xmlns="{NS["S"]}" xmlns:r="{REL}"><sheets><sheet name="a@x.org" sheetId="1" r:id="r1"/><sheet name="d@x.org" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("worksheet", "worksheets/sheet1.xml"), ("worksheet", "/xl/worksheets/sheet2.xml"), ("sharedStrings", "sharedStrings.xml")), "xl/sharedStrings.xml": f'<sst xmlns="{NS["S"]}"><si><t>a@x.org</t></si></sst>',
        "xl/worksheets/sheet1.xml": sheet(row(1, text("A1", "Salary"), text("B1", "Qty"), text("C1", "Mail")), row(2, '<c r="A2"><v>1200</v></c>', "<c><v>5</v></c>", '<c r="C2" t="s"><v>0</v></c>', "<c t=\"e\"><v>#N/A</v></c>", '<c t="d"><v>2024-01-01</v></c>'),
                                          row(3, "<c r=\"A3\"><f>'d@x.org' !A1</f><v>1</v></c>", '<c r="B3" t="b"><v>1</v></c>', "<c r=\"C3\"/>")),
        "xl/worksheets/_rels/sheet1.xml.rels": rels(("drawing", "../drawings/drawing1.xml")), "xl/drawings/_rels/drawing1.xml.rels": rels(("chart", "../charts/chart3.xml")), "xl/drawings/drawing1.xml": "<x/>",
        "xl/charts/chart3.xml": f'<c:chartSpace xmlns:c="{NS["C"]}" xmlns:a="{NS["A"]}"><c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>by a@</a:t></a:r><a:r><a:t>x.org</a:t></a:r></a:p></c:rich></c:tx></c:title></c:chart></c:chartSpace>',
        "xl/worksheets/sheet2.xml": sheet(row(1, text("A1", "e@x.org"))),
    })


@pytest.fixture(scope="module")
def files(spark):
    broken = [("bad.docx", b"broken"), ("bad.pptx", package({"ppt/presentation.xml": "<x"})), ("bad.xlsx", package({"xl/workbook.xml": workbook()[:40].hex()}))]
    return spark.createDataFrame([("in/a.docx", word()), ("in/b.pptx", slides()), ("in/c.xlsx", workbook()), *broken], "path string, content binary")


def rows_of(processed):
    return {r["path"]: [x for x in ooxml.read_package(r["path"], bytes(r["content"]))] for r in processed.files.collect()}


def texts(rows, *areas):
    return [r.get("text") for r in rows if r["area"] in areas]


def test_files_are_redacted(files, spark, tmp_path):
    done = redact_files(files, Anonymizer("balanced", "en"))
    got = rows_of(done)
    assert set(got) == {"in/a_anonymized.docx", "in/b_anonymized.pptx", "in/c_anonymized.xlsx"}
    w = got["in/a_anonymized.docx"]
    assert texts(w, "body") == ["Report", "[NAME_1] wrote [EMAIL_1]", "w " * 100] and texts(w, "textbox") == ["box [EMAIL_2]"] and texts(w, "header") == ["head [EMAIL_1]"] and texts(w, "footer") == ["foot"]
    assert next(r["segments"] for r in w if r["text"].startswith("[NAME_1] wrote")) == ["[NAME_1]", " wrote [EMAIL_1]", ""]
    assert {r["name"]: r["text"] for r in w if r["area"] in ("author", "property")} == {"creator": "[NAME_1]", "lastModifiedBy": "[NAME_7]", "title": "Mail [EMAIL_1]", "subject": "plain"}
    assert texts(got["in/b_anonymized.pptx"], "shape", "table", "note") == ["first", "sub", "foot", "[EMAIL_1]", "second [EMAIL_1]", "more", "x1", "[EMAIL_2]", "note [EMAIL_2]"]
    x = got["in/c_anonymized.xlsx"]
    assert [(r["row"], r["col"], r.get("text") if r["dtype"] != "n" else r["d"]) for r in x if r["area"] == "cell" and r["sheet_ord"] == 1] == [
        (1, 1, "Salary"), (1, 2, "Qty"), (1, 3, "Mail"), (2, 1, "[VALUE_1]"), (2, 2, 5.0), (2, 3, "[EMAIL_1]"), (2, 4, "#N/A"), (2, 5, "2024-01-01"), (3, 1, "='d@x.org' !A1"), (3, 2, None),
    ]
    assert texts(x, "sheet") == ["(EMAIL_1)", "d@x.org"] and texts(x, "chart") == ["by [EMAIL_1]"]
    stats = {r["path"]: r for r in done.stats.collect()}
    assert stats["in/c.xlsx"]["numeric_cells"] == 1 and {w["code"] for w in stats["in/c.xlsx"]["warnings"]} == {"recogniser_missing", "sheet_not_renamed"}
    assert stats["in/a.docx"]["metadata_cleaned"] == 2 and stats["in/a.docx"]["engine"] == "regex-only" and sorted(stats["in/a.docx"]["labels"]) == ["[EMAIL_1]", "[EMAIL_2]", "[NAME_1]"]
    assert {r["path"] for r in done.faults.collect()} == {"bad.docx", "bad.pptx", "bad.xlsx"}
    written = ooxml.write_files(done.files, f"file://{tmp_path}").collect()
    assert {r["path"].rsplit("/", 1)[-1] for r in written} == {p.name for p in tmp_path.iterdir()} and len(written) == 3


def test_files_are_labelled(files):
    done = label_files(files, "en")
    got = rows_of(done)
    w = got["in/a_structure.docx"]
    assert texts(w, "body") == ["[DOCUMENT TITLE]", "[PARAGRAPH CONTENT 1]", "[PARAGRAPH CONTENT 2]"] and texts(w, "textbox", "header", "footer", "table") == ["[TEXT BOX 1]", "[TABLE CELL ROW-1 COL-1]", "[HEADER]", "[FOOTER]"]
    assert texts(got["in/b_structure.pptx"], "shape", "table", "note") == [
        "[SLIDE TITLE 1]", "[SLIDE SUBTITLE 1]", "[SLIDE FOOTER]", "[BODY TEXT 2]", "[SHAPE LABEL 1]", "[TABLE CELL SLIDE-2 ROW-1 COL-1]", "[TABLE CELL SLIDE-2 ROW-1 COL-2]", "[PRESENTER NOTE SLIDE-2]",
    ]
    x = got["in/c_structure.xlsx"]
    assert texts(x, "cell") == [
        "[HEADER COL-1]", "[HEADER COL-2]", "[HEADER COL-3]", "[NUMERIC VALUE 1]", "[NUMERIC VALUE 2]", "[DATA ROW-2 COL-3]", "[DATA ROW-2 COL-4]", "[DATA ROW-2 COL-5]", "[FORMULA 1]", "[NUMERIC VALUE 3]", "[HEADER COL-1]",
    ]
    assert texts(x, "sheet") == ["(SHEET NAME 1)", "(SHEET NAME 2)"] and texts(x, "chart") == ["[CHART TITLE 1]"]
    stats = {r["path"]: r for r in done.stats.collect()}
    assert stats["in/c.xlsx"]["total"] == 14 and stats["in/c.xlsx"]["labels"][:2] == ["(SHEET NAME 1)", "[HEADER COL-1]"]
    with zipfile.ZipFile(io.BytesIO(bytes(next(r["content"] for r in done.files.collect() if r["path"].endswith("docx"))))) as z:
        assert z.read("word/document.xml").count(b"<w:br/>") == 2


def test_wrong_requests_are_refused(spark):
    for path, mode in (("x.pdf", "pii"), ("x.docx", "other")):
        with pytest.raises(ValueError):
            process_path(spark, path, mode)
