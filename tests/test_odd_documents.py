"""Queries over documents against their SQL where texts are empty, blank or missing."""

import duckdb
import pytest

from parchmill.operators import parse
from parchmill.plans.registry import ORACLES, QUERIES
from parchmill.sources.discovery import read_tei

from .test_oracles import rows

ODD = [
    (0, "", "en"),
    (1, "", "de"),
    (2, "\nsecond line", "en"),
    (3, " \t　\nblank first", "fr"),
    (4, "title  with  blanks\nand more", " x  y "),
    (5, None, "en"),
    (8, 'a "quoted" & <marked> \\ title', ""),
    (9, "no language", None),
    (10, "\r\nb", "es"),
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    db.executemany("insert into documents values (?, ?, ?, 's', 1)", ODD)
    db.execute(f"copy documents to '{folder}/documents.parquet' (format parquet)")
    return str(folder), db


@pytest.mark.parametrize("name", ["json_files", "paper_json", "tei_files", "normalize_ws", "sections_roundtrip", "section_chunks"])
def test_same_rows(spark, odd, name):
    folder, db = odd
    df = QUERIES[name](spark, folder)
    answer = db.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert rows(df.columns, df.collect()) == rows(columns, answer.fetchall())


def test_empty_tei_file(spark, tmp_path):
    for name, body in (("a b.tei.xml", ""), ("c.tei.xml", "x"), ("d.txt", ""), ("_e.tei.xml", ""), ("f.tei.XML", "")):
        (tmp_path / name).write_text(body)
    for source in (str(tmp_path), f"file://{tmp_path}"):
        got = {r["path"].rpartition("/")[2]: r["tei_xml"] for r in read_tei(spark, source).collect()}
        assert got == {"a%20b.tei.xml": "", "c.tei.xml": "x", "f.tei.XML": ""}
        assert len({r["path"].rpartition("/")[0] for r in read_tei(spark, source).collect()}) == 1


def test_tasks_follow_rows(spark, tmp_path, monkeypatch):
    """One row group is dealt out, by rows and not by bytes; a table of many even tasks is left as it is."""
    path = str(tmp_path / "t.parquet")
    spark.range(9000).coalesce(1).write.parquet(path)
    monkeypatch.setattr(parse, "ROWS_PER_TASK", 1000)
    table = spark.read.parquet(path)
    assert parse.spread(table).rdd.getNumPartitions() == 9
    sizes = parse.grouped(table, "id").count().rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 9 and max(sizes) < 1500
    even = spark.range(8000).repartition(8)
    assert parse.spread(even) is even


def test_parts_make_no_more(spark, monkeypatch):
    """A query reads its own members of the flat record, and a document that breaks the rules elsewhere still fails."""
    xml = "<TEI><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt><publicationStmt/><sourceDesc/></fileDesc></teiHeader><text><body>{}</body></text></TEI>"
    df = spark.createDataFrame([(xml.format("<p>x</p>"),), (xml.format("<quote/>"),)], "tei_xml string").coalesce(1)
    flat = parse.with_parsed(df, reads=("titles",)).select("flat.*")
    assert flat.columns == ["error", "titles"]
    good, bad = flat.collect()
    assert good["titles"][0]["text"] == "T" and good["error"] is None and "quote" in bad["error"]
    with pytest.raises(ValueError):
        parse.parse_tei(df["tei_xml"], reads=("bibl.nothing",))
