import datetime
import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope import __main__ as commands
from folioscope.functions import search, text
from folioscope.operators import ingest, retrieval
from folioscope.plans import registry
from folioscope.sources import files, questions
from folioscope.streaming.watch import Snapshots, reindex, scan

SF = "/root/testdata/sf0.001"
W = 'xmlns:w="w" xmlns:r="r" xmlns:a="a" xmlns:p="p"'


def package(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def rels(**to) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Type="t/{kind}" Target="{target}"{more}/>' for k, (kind, target, *m) in to.items() for more in [m[0] if m else ""]) + "</Relationships>"


CORE = '<c xmlns:dc="d"><dc:title> Plan </dc:title><dc:creator>Ann</dc:creator><dc:keywords></dc:keywords></c>'


def read(name, data, **how):
    out, meta, why = files.extract_one(name, data, **how)
    return out, json.loads(meta), why


def test_extensions():
    want = ".txt .md .markdown .rst .log .vtt .srt .pdf .docx .pptx .xlsx .msg .eml .png .jpg .jpeg .tif .tiff .bmp .webp .gif".split()
    assert sorted(files.DOCUMENTS + files.IMAGES) == sorted(want) and len(want) == 21


def test_docx():
    cell = lambda t: f"<w:tc><w:p><w:t>{t}</w:t></w:p></w:tc>"
    body = f"<w:document {W}><w:body><w:p><w:t>one</w:t></w:p><w:tbl><w:tr>{cell('k')}{cell('v')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl><w:p/><w:p><w:t>two</w:t></w:p></w:body></w:document>"
    data = package(**{"word/document.xml": body, "docProps/core.xml": CORE, "word/media/a.png": b"A", "word/media/b.png": b"A", "word/media/c.png": b"C"})
    got, meta, why = read("x.docx", data)
    assert (got, why) == ("one\n\ntwo\n\nk | v\n\nk: 1 | v: 2", None) and meta == {"source_format": "docx", "title": "Plan", "author": "Ann"}
    got, meta, _ = read("x.docx", data, engine=lambda b: f"seen {b.decode()}", limit=1)
    assert got.endswith("[Image text: a.png]\nseen A") and meta["embedded_image_count"] == 3 and meta["repeated_image_count"] == 1 and meta["ocr_image_count"] == 1


def test_pptx_keeps_the_order_of_slides_and_shapes():
    box = lambda t: f"<p:sp><p:txBody><a:p><a:t>{t}</a:t></a:p></p:txBody></p:sp>"
    cells = lambda *ts: "<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:t>{t}</a:t></a:p></a:txBody></a:tc>" for t in ts) + "</a:tr>"
    slide = lambda inner: f"<p:sld {W}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    table = f"<p:graphicFrame><a:tbl>{cells('h', 'i')}{cells('1', '2')}</a:tbl></p:graphicFrame>"
    picture = '<p:pic><p:blipFill><a:blip r:embed="rId9"/></p:blipFill></p:pic><p:pic><p:blipFill><a:blip r:embed="rId8"/></p:blipFill></p:pic>'
    notes = f"<p:notes {W}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type='sldNum'/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:t>7</a:t></a:p></p:txBody></p:sp><p:sp><p:nvSpPr><p:nvPr><p:ph type='body'/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:t>said</a:t></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:notes>"
    data = package(**{
        "ppt/presentation.xml": f"<p:presentation {W}><p:sldIdLst><p:sldId id='1' r:id='b'/><p:sldId id='2' r:id='a'/><p:sldId id='3' r:id='c'/></p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": rels(a=("slide", "slides/slide1.xml"), b=("slide", "slides/slide2.xml"), c=("slide", "slides/slide3.xml")),
        "ppt/slides/slide1.xml": slide(box("last")), "ppt/slides/slide3.xml": slide(""), "ppt/slides/slide2.xml": slide(f"{box('top')}{table}<p:grpSp>{box('grouped')}</p:grpSp>{picture}"),
        "ppt/slides/_rels/slide2.xml.rels": rels(n=("notesSlide", "../notesSlides/notesSlide5.xml"), rId9=("image", "../media/i.png"), rId8=("image", "http://x/y.png", ' TargetMode="External"')),
        "ppt/notesSlides/notesSlide5.xml": notes, "ppt/media/i.png": b"I"})
    got, meta, why = read("x.pptx", data, engine=lambda b: b.decode())
    assert why is None and got == "top\nh | i\nh: 1 | i: 2\ngrouped\nsaid\n\nlast\n\n[Image text: slide 1]\nI" and meta["slide_count"] == 3


def test_xlsx_follows_the_workbook():
    n = 'xmlns:r="r"'
    row = lambda i, *cs: f'<row r="{i}">{"".join(cs)}</row>'
    s = lambda at, t: f'<c r="{at}" t="inlineStr"><is><t>{t}</t></is></c>'
    data = package(**{
        "xl/workbook.xml": f'<workbook {n}><sheets><sheet name="Later" r:id="x2"/><sheet name="First" r:id="x1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(x1=("worksheet", "worksheets/sheet1.xml"), x2=("worksheet", "/xl/worksheets/sheet2.xml")),
        "xl/styles.xml": '<s><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></s>',
        "xl/worksheets/sheet1.xml": "<w><sheetData>" + row(1, s("A1", "a"), s("B1", "b")) + row(3, '<c r="B3" s="1"><v>45658</v></c>') + row(4, '<c r="A4" s="2"><v>45658.5</v></c><c r="B4" s="3"><v>2.5</v></c>') + row(5, '<c r="A5" t="b"><v>1</v></c><c r="B5"><v>7</v></c>') + "</sheetData></w>",
        "xl/worksheets/sheet2.xml": "<w><sheetData>" + row(1, s("A1", "only")) + row(5001, s("A5001", "too far")) + "</sheetData></w>"})
    got, meta, why = read("x.xlsx", data)
    assert why is None and got == "# Later\nonly\n\n# First\na | b\nb: 2025-01-01 00:00:00\na: 2025-01-01 12:00:00 | b: 2.5\na: True | b: 7"
    assert meta["sheet_names"] == ["Later", "First"] and meta["row_limit_reached"] is True


def test_mail_and_broken_files():
    mail = b"Subject: Hi\nFrom: a@b.c\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/html\n\n<style>no</style><p>Dear <b>you</b></p>\n--x\nContent-Type: image/png\nContent-Disposition: attachment; filename=p.png\n\nPNG\n--x--\n"
    got, meta, why = read("m.eml", mail, engine=lambda b: "shown")
    assert why is None and got == "Subject: Hi\nFrom: a@b.c\nAttachments: p.png\n\nDear you\n\n[Image text: p.png]\nshown" and meta["attachment_names"] == ["p.png"]
    assert read("a.docx", b"")[2] == "empty" and read("a.docx", files.OLE + b"x")[2] == "pre-2007 format" and read("a.docx", b"zip?")[2].startswith("unreadable") and read("a.pdf", b"x")[2] == "no reader for this format"
    assert read("a.png", b"x")[2] == "no reader for this format" and read("d/a.png", b"x", engine=lambda b: "words")[0] == "[Image text: a.png]\nwords"


def test_html_lines():
    assert search.html_text("a<br><br> <br><br>b  c<script>x<b>y</script>\n\n\n<p>d</p>") == "a\n\nb c\n\nd"
    assert search.html_text(None) == "" and search.html_text("<td>x<th>y") == "| xy" and search.html_text("x &lt; y") == "x < y"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_date_labels_and_bad_durations(spark, tmp_path):
    assert one(spark, text.labelled(F.col("c"), "date"), c="Date: soon\nStarted: 3 May 2026\n") == "3 May 2026"
    assert one(spark, text.labelled(F.col("c"), "title"), c='Topic: "Plan"\n') == "Plan"
    vtt = "WEBVTT\n\nNOTE Duration: long\n\n00:00:01.000 --> 00:00:02.500\n<v Ann>hello"
    d = spark.createDataFrame([("a.vtt", datetime.datetime(2026, 1, 1), "{}", vtt, None), ("b.md", datetime.datetime(2026, 1, 1), "{}", "---\n- a list\n- x: [\n---\nbody", None), ("c.md", datetime.datetime(2026, 1, 1), "{}", None, "empty")],
                              "source_path string, modificationTime timestamp, metadata_json string, text string, skipped string")
    assert {r["source_path"]: r["outcome"] for r in ingest.headed(d).collect()}["c.md"] == "skipped"
    first = ingest.parse(d).where("source_path = 'a.vtt'").first()
    assert "duration_seconds" not in json.loads(first["metadata_json"]) and json.loads(first["metadata_json"])["speakers"] == ["Ann"]


def test_scan_counters_cache_and_commands(spark, tmp_path, monkeypatch):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.md").write_text("# Heading\nred fox body")
    (inbox / "_b.log").write_text("log of a blue whale")
    (inbox / "z_copy.md").write_text("# Heading\nred fox body")
    (inbox / "empty.txt").write_text("")
    (inbox / "bad.docx").write_bytes(package(**{"word/document.xml": "<d/>"}))
    snaps, p = Snapshots(spark, f"file://{tmp_path}/index"), ingest.HashEmbedding(64)
    got = scan(spark, str(inbox), snaps, p)
    assert got == {"added": 2, "updated": 0, "unchanged": 0, "removed": 0, "failed": 1, "skipped": 1, "duplicates": 1}
    assert {r["source_path"] for r in snaps.read("documents").collect()} == {"a.md", "_b.log"}
    read_again = files.extract(files.discover(files.listing(spark, str(inbox))), snaps.read("extractions").withColumn("text", F.concat("text", F.lit(" cached"))))
    assert {r["source_path"]: r["text"] for r in read_again.collect()}["a.md"].endswith(" cached")
    call = lambda *a: commands.run(spark, ["--index", f"file://{tmp_path}/index", *a])
    assert call("status")["documents"] == 2 and call("ingest-once", str(inbox))["unchanged"] == 2
    asked = call("query", "red fox body", "--top-k-documents", "1")
    assert asked["documents"] == [] or asked["documents"][0]["source_path"] == "a.md"
    (tmp_path / "q.json").write_text(json.dumps([{"question": "red fox", "expect": "a.md"}, {"question": "nothing", "expect": []}]))
    report = call("eval", str(tmp_path / "q.json"), "--verbose")
    assert report["questions"] == 2 and report["scored"] == 1 and len(report["results"]) == 2
    other = ingest.HashEmbedding(16)
    assert reindex(spark, snaps, other)["chunks"] == 2 and snaps.read("chunks").select(F.size("embedding")).distinct().first()[0] == 16
    assert scan(spark, str(inbox), snaps, p)["unchanged"] == 2 and snaps.read("chunks").select(F.size("embedding")).distinct().first()[0] == 64
    assert call("rebuild", str(inbox))["updated"] == 2


def test_questions_and_boundaries(spark, tmp_path):
    for bad in ("{}", "[1]", '[{"question": " "}]'):
        (tmp_path / "q").write_text(bad)
        if bad == "{}":
            assert questions.load(str(tmp_path / "q")) == []
            (tmp_path / "q").write_text('{"a": 1}')
        with pytest.raises(ValueError):
            questions.load(str(tmp_path / "q"))
    assert retrieval.boundary(" ", "since") is None and retrieval.boundary("3 May 2026", "since") == datetime.datetime(2026, 5, 3, tzinfo=datetime.timezone.utc)
    with pytest.raises(ValueError):
        retrieval.boundary("never", "since")
    for q in ({"question": " "}, {"question": "x", "since": "2026-02-01", "until": "2026-01-01"}):
        with pytest.raises(ValueError):
            retrieval.requests(spark, ingest.HashEmbedding(4), [q])


def test_a_failing_scorer_leaves_the_pool_as_it_is(spark):
    class Broken:
        def score(self, query, passages):
            if query == "bad":
                raise RuntimeError
            return [len(p) for p in passages]

    rows = [(q, f"{q}{i}", q, "t", "x" * (i + 1), 0.5, 0.5, i) for q in ("good", "bad") for i in range(3)] + [("lone", "lone0", "lone", "t", "x", 0.5, 0.5, 0)]
    pool = spark.createDataFrame(rows, "query_id string, chunk_id string, query string, title string, content string, semantic_score double, lexical_score double, pool_pos int")
    got = retrieval.reranked(pool, retrieval.model_scores(Broken(), F.col("query"), F.col("title"), F.col("content"))).orderBy("query_id", "final_pos").collect()
    assert [r["chunk_id"] for r in got if r["query_id"] == "bad"] == ["bad0", "bad1", "bad2"] and all(r["rerank_score"] is None for r in got if r["query_id"] in ("bad", "lone"))
    assert [r["rerank_score"] for r in got if r["query_id"] == "good" and r["chunk_id"] == "good2"] == [6.0]


def test_inspection_filters_and_total(spark):
    docs, chunks = registry.corpus(spark, SF), registry.chunk_table(spark, SF)
    got = retrieval.inspect(docs, chunks, 5, 2, project="en", active=True).collect()
    want = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet' WHERE lang = 'en' AND doc_id % 10 <> 9").fetchall()[0][0]
    assert len(got) == 5 and {r["total"] for r in got} == {want}
    one_ = retrieval.inspect(docs, chunks, document_id="3", full=True, vectors=True).first()
    assert one_["document_id"] == "3" and one_["total"] == 1 and all(len(c["first_values"]) == c["dimensions"] for c in one_["chunks"] or ())


def test_no_scored_case_gives_null(spark):
    r = spark.createDataFrame([], "query_id long, doc_rank int, source_path string")
    q = spark.createDataFrame([(1, "q", [])], "query_id long, question string, expect array<string>")
    assert retrieval.evaluate(r, q).select("scored", "hit_rate", "mrr").first() == (0, None, None)


def test_ranks_are_made_without_texts(spark):
    plan = registry.QUERIES["hybrid_search"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("content#" in line for line in windows)


@pytest.mark.parametrize("name", ["json_metadata", "trigram_similarity", "pool_documents", "list_documents", "inspect_documents", "normalised_shingles", "titles", "recency_scores", "scan_counts", "index_status", "fetch_chunk"])
def test_more_queries_match_their_sql(spark, name):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in "events documents embeddings benchmark".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({registry.SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())
