import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark.dims import EXTENSIONS, extension_table
from shelfmark.operators.classify import classify
from shelfmark.sources import documents, listing, tables
from tests.conftest import rows


@pytest.fixture
def tree(tmp_path):
    for name in (".hid.txt", "_under.txt", "a.txt", "sub/deep/b.mp3", ".cache/c.txt", "private-x/d.txt", "secret-note.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"test")
        os.utime(p, ns=(1_700_000_000_000_000_007, 1_700_000_000_000_000_007))
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    return tmp_path


def test_listing(spark, tree):
    listing.register(spark)
    df = spark.read.format("listing").option("private", "private-x、secret").option("head_bytes", 2).load(str(tree))
    got = {r["path"]: r for r in df.collect()}
    assert set(got) == {".hid.txt", "_under.txt", "a.txt", "sub", "sub/deep", "sub/deep/b.mp3", ".cache", "private-x", "secret-note.txt", "link.txt"}
    assert got["link.txt"]["is_link"] and got["a.txt"]["mtime_ns"] == 1_700_000_000_000_000_007
    assert bytes(got["a.txt"]["head"]) == b"te" and got["secret-note.txt"]["head"] is None and got["secret-note.txt"]["private"]
    flat = spark.read.format("listing").option("recursive", "false").load(str(tree))
    assert flat.filter("path like '%/%'").count() == 0


def test_one_file_of_each_category(spark):
    names = ["plan.odt", "novel.mobi", "scan.webp", "clip.mkv", "song.flac", "film.ass", "back.7z", "setup.msi", "serif.otf", "flake.nix", "blob.zzz"]
    got = classify(spark.createDataFrame([(n,) for n in names], "name string"), extension_table(spark))
    assert got.select("category").distinct().count() == 11
    more = classify(spark.createDataFrame([("x.unknown",)], "name string"), extension_table(spark, {"unknown": "代码"}))
    assert more.head()["category"] == "代码" and EXTENSIONS["pdb"] == EXTENSIONS["mts"] == "代码"


def test_content_decides(spark):
    data = [("package.json", b"{}"), ("notes.md", b"prose"), ("guide.md", b"import x"), ("config.json", b'{"a": 1}'), ("v.ts", b"G" + b"x" * 187 + b"Gx"), ("t.ts", b"const a = 1"), ("o.m", b"#import <x>"), ("f", b"%PDF-1"), ("g", b"#!/bin/sh"), ("h", b"\x89PNG\r\n\x1a\n"), ("b.md", b"\0import ")]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in data], "name string, content binary")
    got = dict(rows(classify(df, extension_table(spark), "content"), "name", "category"))
    assert got == {"package.json": "代码", "notes.md": "文档资料", "guide.md": "代码", "config.json": "其它", "v.ts": "视频", "t.ts": "代码", "o.m": "代码", "f": "文档资料", "g": "代码", "h": "图片", "b.md": "文档资料"}


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_document_formats(spark):
    long = b"BEGIN" + b"A" * 12000 + b"MIDDLE" + b"B" * 12000 + b"END"
    docx = archive(**{"word__document.xml": "<d xmlns='u'><t>第一</t><t>second</t></d>", "word__bad.xml": "<x"})
    xlsx = archive(**{"xl__workbook.xml": "<w><sheet name='销售'/></w>", "xl__sharedStrings.xml": "<s><si><t>华东</t></si></s>", "xl__worksheets__sheet1.xml": "<w><row><c t='s'><v>0</v></c><c><v>42</v></c><c t='b'><v>1</v></c></row></w>"})
    data = [("n.txt", "中文a".encode("gb18030")), ("l.txt", long), ("d.docx", docx), ("s.xlsx", xlsx), ("p.pdf", b"%PDF"), ("z.docx", b"no zip"), ("q.xyz", b""), ("gone.txt", None)]
    df = spark.createDataFrame([(n, n, None if c is None else bytearray(c)) for n, c in data], "path string, name string, content binary")
    got = {r["path"]: r for r in documents.extracted(df, 3000).collect()}
    assert got["n.txt"]["text"] == "中文a"
    assert all(m in got["l.txt"]["text"] for m in ("BEGIN", "MIDDLE", "END")) and got["l.txt"]["truncated"]
    assert "第一\nsecond" in got["d.docx"]["text"] and got["d.docx"]["method"] == "docx-sampled"
    assert "销售" in got["s.xlsx"]["text"] and "华东 | 42 | TRUE" in got["s.xlsx"]["text"]
    assert [got[k]["method"] for k in ("p.pdf", "z.docx", "q.xyz", "gone.txt")] == ["installation-required", "unavailable", "unsupported", "unavailable"]
    with_reader = documents.extracted(df.filter("path = 'p.pdf'"), 3000, {".pdf": lambda raw, limit: ("page", False)}).head()
    assert with_reader["text"] == "page"


def test_slices_keep_characters_whole(spark):
    df = spark.createDataFrame([("a.txt", "a.txt", bytearray("汉字".encode() * 20_000))], "path string, name string, content binary")
    text, cut = documents.extracted(df, 1000).select("text", "truncated").head()
    assert cut and "�" not in text and set(text) <= set("汉字[]开头中间结尾…\n")


def test_all_extensions_of_code(spark):
    names = [f"x.{e}" for e in "nix hcl prisma sbt ksh raku erb handlebars jinja2 rmd psm1".split()]
    got = classify(spark.createDataFrame([(n,) for n in names], "name string"), extension_table(spark))
    assert got.filter("category <> '代码'").count() == 0 and len(EXTENSIONS) == 489


def test_members_and_sheets_are_sampled(spark):
    """Evenly chosen members and rows; a damaged member is passed over, a damaged sheet makes the file unavailable."""
    slides = archive(**{f"ppt__slides__slide{k:02}.xml": f"<s><t>slide {k} text</t></s>" for k in range(1, 12)}, ppt__media__x="no")
    book = archive(**{f"OEBPS__c{k}.xhtml": f"<h><p>chapter {k}</p> tail {k}</h>" for k in range(3)}, **{"OEBPS__broken.xhtml": "<h><p>"})
    sheet = "<w>" + "".join(f"<row><c><v>{k}</v></c><c t='inlineStr'><is><t>in {k}</t></is></c><c><f>SUM(A1)</f><v>9</v></c></row>" for k in range(101)) + "</w>"
    xlsx = archive(**{"xl__workbook.xml": "<w><sheet name='One'/></w>", "xl__worksheets__sheet1.xml": sheet, "xl__worksheets__sheet2.xml": "<w><row><c t='b'><v>0</v></c></row></w>"})
    bad = archive(**{"xl__worksheets__sheet1.xml": "<w><row>"})
    data = [("s.pptx", slides), ("b.epub", book), ("w.xlsx", xlsx), ("v.xlsx", bad)]
    got = {r["path"]: r for r in documents.extracted(spark.createDataFrame([(n, n, bytearray(c)) for n, c in data], "path string, name string, content binary"), 3000).collect()}
    assert got["s.pptx"]["text"] == "\n\n".join(f"[{i}/6 slide{k:02}.xml]\nslide {k} text" for i, k in enumerate((1, 3, 5, 7, 9, 11), 1)) and got["s.pptx"]["truncated"]
    assert got["b.epub"]["text"] == "\n\n".join(f"[{k + 2}/4 c{k}.xhtml]\nchapter {k}\ntail {k}" for k in range(3))
    lines = got["w.xlsx"]["text"].split("\n")
    assert lines[:4] == ["工作表：One", "[One]", "0 | in 0 | SUM(A1)", "5 | in 5 | SUM(A1)"] and lines[-3:] == ["100 | in 100 | SUM(A1)", "[sheet2]", "FALSE"] and len(lines) == 24 and got["w.xlsx"]["truncated"]
    assert got["v.xlsx"]["method"] == "unavailable" and got["v.xlsx"]["error"] == "damaged sheet"


def test_json_tables(spark, tmp_path):
    assert tables.read_json(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "x.json").write_text('{"a": 1}\nbroken\n')
    assert rows(tables.read_json(spark, str(tmp_path / "x.json"), "a int")) == [(1,)]
    tables.write_json(spark.range(2).select(F.col("id").alias("a")), str(tmp_path / "out"))
    assert tables.read_json(spark, str(tmp_path / "out"), "a int").count() == 2
    for run in ("r1", "r2"):
        tables.append(spark.range(1).withColumn("run", F.lit(run)), str(tmp_path / "log"), "run")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
