"""Strict TEI parsing and the projection to papers, case by case."""

import json
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parchmill.operators import tei_extract
from parchmill.operators.paper import paper
from parchmill.operators.parse import flat_or_error, with_parsed
from parchmill.operators.tei_schema import check_quickly

CASES = json.loads((pathlib.Path(__file__).parent / "tei_cases.json").read_text())
SHELL = (
    '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt>{title}</titleStmt><publicationStmt></publicationStmt>'
    "<sourceDesc>{source}</sourceDesc></fileDesc></teiHeader><text><body>{body}</body><back>{back}</back></text></TEI>"
)


def shell(title="", source="", body="", back=""):
    return SHELL.format(title=title, source=source, body=body, back=back)


def pruned(value):
    """Without null and empty members, as the cases are written."""
    if isinstance(value, dict):
        return {k: p for k, v in value.items() if (p := pruned(v)) is not None and p not in ({}, [])}
    if isinstance(value, list):
        return [pruned(v) if pruned(v) is not None else {} for v in value]
    return value


def keep_titles(value):
    return {k: v for k, v in value.items() if k != "extraction_data" or v}


@pytest.fixture(scope="module")
def papers(spark):
    rows = [(c["name"], c["xml"]) for c in CASES["cases"]] + [("golden", CASES["golden"]["xml"])]
    df = with_parsed(spark.createDataFrame(rows, "name string, tei_xml string")).select("name", "flat.error", F.to_json(paper(F.col("flat")), {"ignoreNullFields": "false"}).alias("json"))
    return {r["name"]: r for r in df.collect()}


@pytest.mark.parametrize("case", CASES["cases"], ids=[c["name"] for c in CASES["cases"]])
def test_case(case, papers):
    got = papers[case["name"]]
    if case["error"]:
        assert got["json"] is None
        word = case["error"].split("`")
        assert got["error"] and (len(word) < 2 or word[1] in got["error"] or word[1] == ">")
    else:
        assert got["error"] is None
        assert pruned(json.loads(got["json"])) == case["paper"]


def test_golden(papers):
    assert json.dumps(json.loads(papers["golden"]["json"]), indent=2, ensure_ascii=False) == CASES["golden"]["json"]


@pytest.mark.parametrize(
    ("title", "expected"),
    [
        ("a\x1fb", "a\x1fb"),
        ("a&#31;b", "a\x1fb"),
        ("T</title><!-- --><title>U", "T"),
        ("caf\u00e9 \u2003 x\u200by", "caf\u00e9 x\u200by"),
        ("a\r\nb", "a b"),
        ("x &lt;&#x41;&gt; &amp;amp;", "x <A> &amp;"),
    ],
)
def test_accepted_text(spark, title, expected):
    flat = flat_or_error(shell(f"<title>{title}</title>"))
    assert flat.get("error") is None
    df = with_parsed(spark.createDataFrame([(shell(f"<title>{title}</title>"),)], "tei_xml string"))
    assert df.select(paper(F.col("flat"))["core"]["title"].alias("t")).first()["t"] == expected


@pytest.mark.parametrize(
    "xml",
    [
        "\ufeff" + shell("<title>T</title>"),
        shell("<title>T</title>") + "junk <second/>",
        shell("<q:title>T</q:title>"),
        shell('<title n="a<b">T</title>'),
        "<!DOCTYPE TEI>" + shell("<title>T</title>"),
        '<?xml version="1.0" encoding="latin-1"?>' + shell("<title>T</title>"),
    ],
)
def test_lax(xml):
    flat = flat_or_error(xml)
    assert flat.get("error") is None and flat["titles"][0]["text"] == "T"


@pytest.mark.parametrize(
    "xml",
    [
        "junk" + shell(),
        shell('<title n="1" n="2">T</title>'),
        shell("<title n=1>T</title>"),
        shell("<title>a & b</title>"),
        shell("<title>T</titel>"),
        '<!DOCTYPE TEI [<!ENTITY e "v">]>' + shell("<title>&e;</title>"),
        shell("<title>&#0;</title>"),
        "",
        "   ",
        "no markup",
        "<TEI>",
        shell("<title>T</title>")[:-3],
    ],
)
def test_rejected(xml):
    assert flat_or_error(xml)["error"]


def test_null_and_deep():
    assert flat_or_error(None)["error"]
    assert flat_or_error(shell(body="<div>" * 5000 + "</div>" * 5000))["error"]


def test_parsed_once(spark, capsys):
    df = with_parsed(spark.createDataFrame([(shell(),)], "tei_xml string")).where("flat.error is null").select(paper(F.col("flat")).alias("p"), "flat.titles")
    df.explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1


def test_lenient(spark):
    body = (
        '<div><head>A</head><p>x<quote>q</quote>y</p><p>z</p><div><p>n</p></div></div><figure xml:id="f0"><head>F</head></figure>'
        '<figure type="table" xml:id="t0"><head>T</head><table><row><cell>a</cell><cell>b</cell></row></table></figure><table/>'
    )
    back = '<listBibl><biblStruct xml:id="b0"><monogr><title>M</title></monogr></biblStruct><biblStruct/></listBibl>'
    xml = shell("<title>A</title><author/><title>B <hi>c</hi> d</title>", "", body, back)
    rows = [(xml,), ("<TEI/>",), ("<TEI>",), (None,)]
    df = with_parsed(spark.createDataFrame(rows, "tei_xml string").coalesce(1), mode="lenient").select("flat.error", paper(F.col("flat")).alias("p"))
    got = df.collect()
    p = got[0]["p"]
    assert [(s["title"], s["text_chunks"]) for s in p["content"]["sections"]] == [("A", ["x y", "z"]), ("", ["n"])]
    assert [f["id"] for f in p["content"]["figures"]] == ["f0"]
    assert [(t["id"], t["caption"], t["raw_content"]) for t in p["content"]["tables"]] == [("t0", "T", "a b"), ("table-2", None, None)]
    assert [r["id"] for r in p["content"]["references"]] == ["b0", "ref-2"] and p["core"]["title"] == "A"
    assert got[1]["p"]["core"]["title"] is None and got[2]["error"] and got[3]["error"]
    assert flat_or_error(xml)["error"]
    with pytest.raises(ValueError):
        from parchmill.operators.tei_extract import flat_document

        flat_document("<TEI/>", "other")


def test_both_readings_agree(monkeypatch):
    """The quick reading against the tokenizer's tree, on the cases and on thousands of damaged and varied copies of them."""
    rng = random.Random(4)
    sources = [c["xml"] for c in CASES["cases"]] + [CASES["golden"]["xml"]]
    sources += [shell(body="<div><head>a</head> x <p>b<ref/> c</p></div>", back='<div><listBibl><biblStruct xml:id="b"><monogr><title level="j"> t\u3000\u00a0 u </title><imprint><date when="2001">x</date></imprint></monogr></biblStruct></listBibl></div>')]
    bits = ["<!-- c -->", "<![CDATA[ a<b ]]>", "<?pi x?>", "\n", "\r\n", "\t", " ", "&amp;", "&#65;", "&#13;", "&nbsp;", "&", "<p>", "</p>", "<x/>", '<title type="main">t</title>', "\u00a0", "\x1f", "<q:p>", ' a="1\n2"', ' type="x"', ' xmlns:type="z"', "<!DOCTYPE a>", "\ufeff"]
    varied = list(sources)
    for _ in range(6000):
        xml = rng.choice(sources)
        for _ in range(1 + (rng.random() < 0.2)):
            at = rng.randint(0, len(xml))
            tags = [m.start() for m in re.finditer("[<>]", xml)]
            at = rng.choice(tags) + rng.randint(0, 1) if tags and rng.random() < 0.7 else at
            xml = xml[:at] + rng.choice(bits) + xml[at:] if rng.random() < 0.7 else xml[:at] + xml[at + rng.randint(1, 30) :]
        varied.append(xml)
    quick = [flat_or_error(x) for x in varied]
    assert sum(check_quickly(x) is not None for x in varied) > 500
    monkeypatch.setattr(tei_extract, "check_quickly", lambda source: None)
    for xml, got in zip(varied, quick, strict=True):
        assert flat_or_error(xml) == got, xml
