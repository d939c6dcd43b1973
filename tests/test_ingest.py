"""Files in, files out: discovery, extraction, parsing, sinks, the log, and the stream."""

import io
import json
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from parchmill.plans.ingest import ingest
from parchmill.sources.discovery import InvalidInput, file_bytes, filter_pdf, pdf_paths, read_pdfs, read_tei
from parchmill.sources.extraction import ExtractionError, HttpExtractor, RequestFailed, UnsuccessfulResponse, extract
from parchmill.sources.sinks import Progress, error_lines, progress_line, progress_text, write_file
from parchmill.streaming.watch import watch

GOOD = (
    '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T {name}</title></titleStmt><publicationStmt/><sourceDesc/></fileDesc></teiHeader>'
    "<text><body><p>x</p></body></text></TEI>"
)


def stub(path, content):
    name = path.rpartition("/")[2]
    if b"refuse" in content:
        raise UnsuccessfulResponse(503, "busy\n  now")
    if b"panic" in content:
        raise RuntimeError("boom")
    return "<TEI><broken/>" if b"broken" in content else GOOD.format(name=name)


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    (source / "below").mkdir(parents=True)
    for name, body in {"b.pdf": "ok", "_a.PDF": "ok", "c.pdf": "broken", "d.pdf": "refuse", "e.pdf": "panic", ".pdf": "no", "f.txt": "no"}.items():
        (source / name).write_text(body)
    (source / "below" / "g.pdf").write_text("ok")
    return source


def names(df):
    return [r["path"].rpartition("/")[2] for r in df.collect()]


def test_discovery(spark, folder):
    assert names(pdf_paths(spark, str(folder))) == ["_a.PDF", "b.pdf", "c.pdf", "d.pdf", "e.pdf"]
    assert names(pdf_paths(spark, f"file://{folder}")) == ["_a.PDF", "b.pdf", "c.pdf", "d.pdf", "e.pdf"]
    assert names(pdf_paths(spark, str(folder / "b.pdf"))) == ["b.pdf"]
    assert {r["stem"] for r in read_pdfs(spark, str(folder)).collect()} == {"_a", "b", "c", "d", "e"}
    for bad in (folder / "f.txt", folder / "none", folder.parent):
        with pytest.raises(InvalidInput):
            pdf_paths(spark, str(bad))
    paths = spark.createDataFrame([("z/b.pdf",), ("z/a.PDF",), ("z/.pdf",), ("z/a.txt",), (None,)], "path string")
    assert names(filter_pdf(paths)) == ["a.PDF", "b.pdf"]


def test_extraction(spark, folder):
    rows = {r["stem"]: r for r in extract(read_pdfs(spark, str(folder)), stub).collect()}
    assert rows["b"]["tei_xml"].startswith("<TEI") and rows["b"]["error_kind"] is None
    assert rows["d"]["error_kind"] == "unsuccessful_response" and "503" in rows["d"]["error_message"]
    assert rows["e"]["error_kind"] == "panic" and rows["e"]["tei_xml"] is None


def test_unreachable_service():
    with pytest.raises(RequestFailed):
        HttpExtractor("http://127.0.0.1:9/")("a.pdf", b"x")
    assert HttpExtractor("http://h:1//").url == "http://h:1/api/processFulltextDocument"
    assert issubclass(UnsuccessfulResponse, ExtractionError)


def test_http_round_trip():
    import http.server
    import threading

    seen = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen["body"] = self.rfile.read(int(self.headers["Content-Length"]))
            seen["path"], seen["type"] = self.path, self.headers["Content-Type"]
            self.send_response(200 if b"%PDF" in seen["body"] else 400)
            self.end_headers()
            self.wfile.write(b"<TEI/>")

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        call = HttpExtractor(f"http://127.0.0.1:{server.server_port}/", timeout=10)
        assert call("/x/a.pdf", b"%PDF-1") == "<TEI/>"
        assert seen["path"] == "/api/processFulltextDocument" and b'name="input"; filename="a.pdf"' in seen["body"] and b"application/pdf" in seen["body"]
        with pytest.raises(UnsuccessfulResponse) as e:
            call("a.pdf", b"no")
        assert e.value.status == 400
    finally:
        server.shutdown()


def test_ingest(spark, folder, tmp_path):
    run = ingest(spark, str(folder), str(tmp_path / "tei"), str(tmp_path / "json"), str(tmp_path / "tables"), stub)
    total = run.summary.first()
    assert (total["total"], total["failure_count"], total["failed"]) == (5, 3, True)
    assert total["line"] == "Processed 5 PDFs: 2 succeeded, 3 failed"
    assert sorted(p.name for p in (tmp_path / "tei").glob("*.xml")) == ["_a.tei.xml", "b.tei.xml", "c.tei.xml"]
    assert sorted(p.name for p in (tmp_path / "json").glob("*")) == ["_a.tei.json", "b.tei.json"]
    text = (tmp_path / "json" / "b.tei.json").read_text()
    paper = json.loads(text)
    assert paper["core"]["title"] == "T b.pdf" and paper["core"]["abstract_text"] is None and paper["content"]["references"] == []
    assert text == json.dumps(paper, indent=2, ensure_ascii=False) and list(paper) == ["core", "publication", "authors", "content", "extraction_data"]
    lines = [r["line"] for r in error_lines(run.status).collect()]
    assert len(lines) == 3 and lines[0].startswith("Error in ") and "busy now" in lines[1] and "missing field `teiHeader`" in lines[0] or "not found" in lines[0]
    assert read_tei(spark, str(tmp_path / "tei")).count() >= 2


def test_one_bad_file_stops_no_other(spark, folder, tmp_path):
    """A file that cannot be read, a TEI file and a JSON file that cannot be written are errors of their documents."""
    (folder / "x.pdf").symlink_to(tmp_path / "nowhere")
    (tmp_path / "tei" / "b.tei.xml").mkdir(parents=True)  # a folder stands where the file should go
    (tmp_path / "json" / "_a.tei.json").mkdir(parents=True)
    paths = spark.createDataFrame([(str(folder / n), n.partition(".")[0]) for n in ("b.pdf", "x.pdf")], "path string, stem string")
    rows = {r["stem"]: r for r in extract(paths, stub).collect()}
    assert rows["b"]["error_kind"] is None and rows["x"]["error_kind"] == "read" and rows["x"]["error_message"].startswith("failed to read PDF: ")
    run = ingest(spark, str(folder), str(tmp_path / "tei"), str(tmp_path / "json"), str(tmp_path / "tables"), stub)
    errors = {r["path"].rpartition("/")[2]: r["errors"] for r in run.status.collect()}
    assert set(errors) == {"_a.PDF", "b.pdf", "c.pdf", "d.pdf", "e.pdf"} and all(len(e) == 1 for e in errors.values())
    assert errors["b.pdf"][0].startswith("failed to write TEI XML: ") and errors["_a.PDF"][0].startswith("failed to export domain paper as JSON: ")
    assert run.papers.where("stem = 'b'").first()["paper"] is None and run.papers.where("stem = '_a'").first()["paper"] is not None
    assert not [p for d in ("tei", "json") for p in (tmp_path / d).rglob("*.part")]
    assert [r["error_message"] is None for r in read_pdfs(spark, str(folder)).orderBy("path").collect()] == [True] * 5


def test_files_go_where_the_address_says(tmp_path):
    write_file(f"file://{tmp_path}/a/b/c.txt", "é")
    write_file(f"{tmp_path}/a/b/c.txt", "ü")
    assert (tmp_path / "a/b/c.txt").read_text() == "ü" and file_bytes(f"file://{tmp_path}/a/b/c.txt") == "ü".encode()


def test_no_content_is_shuffled(spark, folder, capsys):
    paths = spark.createDataFrame([(str(folder / "b.pdf"), "b")], "path string, stem string")
    extract(paths, stub).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "content" not in plan


def test_progress_is_drawn():
    stream, done = io.StringIO(), iter(range(100))
    with Progress(lambda: next(done), 3, 2, stream, 0.01):
        time.sleep(0.1)
    said = stream.getvalue()
    assert "[------------------------] 0/3 | running 2/2" in said and "[########################] 3/3 | running 0/2" in said and said.endswith("\r\x1b[2K")
    assert progress_text(0, 0, 0, 10) == f"[{'#' * 24}] 0/0 | running 0/10" and progress_text(1, 2, 3, 10, 20) == "[############----..."


def test_progress_line_and_text_agree(spark):
    rows = [(c, t, r, 10) for c in (0, 1, 7, 100) for t in (0, 7, 100) for r in (0, 10) if c <= max(t, c)]
    df = spark.createDataFrame(rows, "c int, t int, r int, m int")
    for width in (120, 40):
        got = df.select("c", "t", "r", progress_line(F.least("c", "t"), F.col("t"), F.col("r"), 10, width).alias("line")).collect()
        assert all(x["line"] == progress_text(min(x["c"], x["t"]), x["t"], x["r"], 10, width) for x in got)


def test_twins_are_flagged(spark, tmp_path):
    for name in ("a.pdf", "a.PDF", "b.pdf"):
        (tmp_path / name).write_text("ok")
    run = ingest(spark, str(tmp_path), str(tmp_path / "t"), str(tmp_path / "j"), str(tmp_path / "x"), stub)
    assert run.status.where("shares_stem").count() == 2 and run.status.where("failed").count() == 0


def test_stream(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    pathlib.Path(source).mkdir()
    (tmp_path / "in" / "a.tei.xml").write_text(GOOD.format(name="a"))
    (tmp_path / "in" / "b.tei.xml").write_text("<TEI>")
    watch(spark, source, out, mark).awaitTermination()
    (tmp_path / "in" / "c.tei.xml").write_text(GOOD.format(name="c"))
    watch(spark, source, out, mark).awaitTermination()
    rows = spark.read.parquet(out).select("stem", F.col("paper.core.title").alias("title"), "error_kind").collect()
    assert sorted((r["stem"], r["title"], r["error_kind"]) for r in rows) == [("a.tei", "T a", None), ("b.tei", None, "parse"), ("c.tei", "T c", None)]


def test_command_line(spark, folder, tmp_path, capsys):
    from parchmill.__main__ import main

    where = [str(tmp_path / "t"), str(tmp_path / "j")]
    assert main([str(folder), *where], stub) == 1
    said = capsys.readouterr().err
    assert "Processed 5 PDFs: 2 succeeded, 3 failed" in said and said.count("Error in ") == 3
    assert main([str(folder / "b.pdf"), *where], stub) == 0
    assert "Processed 1 PDF: 1 succeeded, 0 failed" in capsys.readouterr().err
    assert main([str(folder / "f.txt"), *where], stub) == 1
