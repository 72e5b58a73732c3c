"""Files of several kinds into blocks and chunks; the office files are made here."""

import zipfile

from pyspark.sql import functions as F

from graphquarry.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_files(spark, tmp_path):
    para = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("Top", "H1") + para("Low", "H2") + para("some words") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>" + para(" ") + para("Next", "H2")
    styles = '<w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="Heading 2"/></w:style>'
    packed(tmp_path / "d.docx", **{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>"})
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda *t: f"<p:sld {A}>{''.join(map(shape, t))}</p:sld>"
    packed(tmp_path / "s.pptx", **{"ppt/slides/slide10.xml": slide("last"), "ppt/slides/slide2.xml": slide(" "), "ppt/slides/slide1.xml": slide("one", "two")})
    sheet = f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>h</t></is></c></row><row><c r="B2"><v>7</v></c></row></sheetData></worksheet>'
    book = f'<workbook {S}><sheets><sheet name="First" r:id="r1"/><sheet name="Void" r:id="r2"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
    packed(tmp_path / "t.xlsx", **{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": f"<worksheet {S}/>", "xl/sharedStrings.xml": f"<sst {S}><si><t>key</t></si></sst>"})
    for name, raw in {"c.csv": b"x,y\n1,2\n3\n", "e.csv": b"x,y\n", "m.md": "# T\nshort\n\nlonger".encode(), "n.txt": "plain".encode(), "bad.txt": b"\xff\xfe", "bad.docx": b"no zip", "bad.xlsx": b"no zip", "p.pdf": b"%PDF", "u.odd": b"odd", "z.txt": b""}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: r for r in office.parse_files(spark, f"file://{tmp_path}", plug_ins={"image": lambda raw, path: []}).collect()}
    blocks = {k: [tuple(b) for b in r["blocks"]] for k, r in got.items()}
    assert blocks["d.docx"] == [("heading", "Top", 0, "Top", False), ("heading", "Low", 0, "Top / Low", False), ("paragraph", "some words", 0, "Top / Low", False), ("heading", "Next", 0, "Top / Next", False), ("table", "| a | b |", 0, "", True)]
    assert blocks["s.pptx"] == [("paragraph", "[Slide 1]\none\ntwo", 1, "", False), ("paragraph", "[Slide 3]\nlast", 3, "", False)]
    assert blocks["t.xlsx"] == [("table", "[工作表: First]\n| key |  | h |\n|---|---|---\n|  | 7 |  |", 0, "", True)]
    assert blocks["c.csv"] == [("table", "| x | y |\n|--- |\n|---\n| 1 | 2 |\n| 3 | None |", 0, "", True)] and blocks["e.csv"][0][1] == "[空 CSV]"
    assert [b[:2] for b in blocks["m.md"]] == [("heading", "T"), ("paragraph", "short\nlonger")] and blocks["n.txt"] == [("text", "plain", 0, "", False)]
    assert blocks["bad.txt"] == [] and blocks["bad.docx"][0][1].startswith("[DOCX 解析失败] ") and blocks["bad.xlsx"][0][1].startswith("[表格解析失败] ")
    assert blocks["p.pdf"][0][1].startswith("[PDF 解析失败] ") and "plug-in" in got["p.pdf"]["parse_error"] and blocks["u.odd"][0][1] == "odd"
    assert {k for k, r in got.items() if r["parse_error"]} == {"bad.txt", "bad.docx", "bad.xlsx", "p.pdf"}


def test_blocks_to_chunks(spark):
    block = lambda kind, text, path="": (kind, text, 1, path, kind == "table")
    long = "Satz eins; " * 100
    blocks = [block("heading", "H", "H"), block("paragraph", "a" * 10, "H"), block("paragraph", "b" * 55, "H"), block("paragraph", "c", "H"), block("table", "t" * 900), block("text", " "), block("paragraph", long)]
    df = spark.createDataFrame([("d", "word", "p", blocks), ("e", "text", "q", [])], f"doc_id string, doc_type string, path string, blocks {office.BLOCKS}")
    merged = [b["content"] for b in df.select(office.merged_blocks(F.col("blocks")).alias("b")).first()["b"]]
    assert merged == ["H", "a" * 10 + "\n" + "b" * 55, "c", "t" * 900, " ", long]
    got = office.block_chunks(df).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], len(r["content"])) for r in got][:4] == [(0, 1), (1, 66), (2, 1), (3, 900)]
    assert 4 not in {r["chunk_index"] for r in got} and all(len(r["content"]) <= 512 for r in got[4:]) and got[1]["chunk_id"] == "d#chunk-1" and got[1]["heading_path"] == "H"


def test_headings_by_size():
    path = office.pushed_heading(office.pushed_heading([], "A", 20), "B", 15)
    assert path == ["A", "B"] and office.pushed_heading(path, "C", 12) == ["A", "B", "C"] and office.pushed_heading(path, "x", 9) == path
