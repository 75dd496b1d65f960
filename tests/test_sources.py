import os
import zipfile

from docket.sources import files as SRC


def make_pptx(path, slides):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        for i, runs in enumerate(slides, 1):
            body = "".join(f"<a:p><a:r><a:t>{r}</a:t></a:r></a:p>" for r in runs)
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld>{body}</p:sld>")
        z.writestr("ppt/slides/_rels/slide1.xml.rels", "<r/>")


def make_docx(path, paras):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paras)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')


def folder(tmp):
    os.makedirs(f"{tmp}/in/sub")
    make_pptx(f"{tmp}/in/deck.pptx", [["Title", "a &amp; b"], ["Two"]])
    make_docx(f"{tmp}/in/sub/notes.docx", ["First para", "Second"])
    with open(f"{tmp}/in/sub/bad.pptx", "wb") as f:
        f.write(b"not a zip")
    with open(f"{tmp}/in/scan.pdf", "wb") as f:
        f.write(b"%PDF-1.4")
    with open(f"{tmp}/in/readme.txt", "w") as f:
        f.write("skip me")
    with open(f"{tmp}/in/UPPER.PDF", "wb") as f:
        f.write(b"x")
    return f"{tmp}/in"


def test_scan_and_extract(spark, tmp):
    d = folder(tmp)
    files = SRC.scan_files(spark, d)
    assert sorted(r.name for r in files.collect()) == ["bad.pptx", "deck.pptx", "notes.docx", "scan.pdf"]
    got = {r.name: r for r in SRC.extract_archive_text(files).collect()}
    assert got["deck.pptx"].text == "Title\na &amp; b\nTwo\n"
    assert (got["bad.pptx"].text, got["bad.pptx"].status) == ("", "error")
    assert got["notes.docx"].text == "First para\n\nSecond"
    assert got["scan.pdf"].status == "unsupported"


def test_json_rows_and_write(spark, tmp):
    p = f"{tmp}/raw.json"
    with open(p, "w") as f:
        f.write('[{"name": "a.pdf", "text": "x"}, {"name": "b.pdf", "text": null}]')
    rows = SRC.scan_json_rows(spark, p, "name string, text string").collect()
    assert [(r.name, r.text) for r in rows] == [("a.pdf", "x"), ("b.pdf", None)]
    df = spark.createDataFrame([("a", 1, [0.5])], "id string, n int, v array<float>")
    SRC.write_rows(df, f"{tmp}/out")
    assert SRC.collection_get(spark, f"{tmp}/out", ["id"]).columns == ["id"]


def test_damaged_last_slide_gives_no_partial_text(spark, tmp):
    import zipfile
    good, bad = f"{tmp}/good.pptx", f"{tmp}/bad.pptx"
    for path in (good, bad):
        with zipfile.ZipFile(path, "w") as z:
            for i in (1, 2, 3):
                z.writestr(f"ppt/slides/slide{i}.xml", f"<a:t>slide {i}</a:t>")
    raw = bytearray(open(bad, "rb").read())
    at = raw.rindex(b"slide 3")
    raw[at:at + 7] = b"broken!"            # the checksum of the third entry no longer holds
    open(bad, "wb").write(raw)
    got = {r["name"]: (r["text"], r["status"]) for r in SRC.extract_archive_text(SRC.scan_files(spark, tmp)).collect()}
    assert got == {"good.pptx": ("slide 1\nslide 2\nslide 3\n", "ok"), "bad.pptx": ("", "error")}


def test_file_index_over_several_lines(spark, tmp):
    with open(f"{tmp}/idx.json", "w") as f:
        f.write('{\n  "b/x.pdf": "1",\n  "a \\"q\\".pdf": null,\n  "b/x.pdf": "2"\n}\n')
    assert sorted(tuple(r) for r in SRC.scan_file_index(spark, f"{tmp}/idx.json").collect()) == [(0, "b/x.pdf", "2"), (1, 'a "q".pdf', None)]
