"""Column functions against plain Python."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill.functions import dates, paths, text
from parchmill.operators.tei_extract import normal

SPACES = "\t\n\x0b\x0c\r \x85\xa0        　"
OTHERS = "ab\x1c\x1d​é中<&\U0001f600"
words = st.lists(st.text(alphabet=SPACES + OTHERS, max_size=12), min_size=1, max_size=40)
slow = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@given(words)
@slow
def test_white_space(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    got = [r["n"] for r in df.orderBy("i").select(text.normalized_opt(F.col("t")).alias("n")).collect()]
    assert got == [normal(v) for v in values]
    assert got == [" ".join(p for p in re.split(f"[{SPACES}]+", v) if p) or None for v in values]


@given(st.lists(st.one_of(st.none(), st.sampled_from(["b", "a", "A", "b ", ""])), max_size=8))
@slow
def test_unique(spark, values):
    df = spark.createDataFrame([(values,)], "v array<string>")
    seen = list(dict.fromkeys(v for v in values if v is not None))
    assert df.select(text.unique(F.col("v")).alias("u")).first()["u"] == seen


def spec(value):
    """A partial date by bytes."""
    t = value.strip("".join(c for c in SPACES))
    m = re.search("[0-9]{4}", t)
    if not m or not 1000 <= int(m.group()) <= 3000:
        return None

    def part(a, low, high):
        b = t.encode()[a : a + 2]
        if len(b) == 2 and re.fullmatch(rb"[0-9]{2}|\+[0-9]", b) and low <= int(b) <= high:
            return int(b)
        return None

    return (int(m.group()), part(5, 1, 12), part(8, 1, 31))


@given(st.lists(st.text(alphabet="0123459-/+ é.", max_size=12), min_size=1, max_size=60))
@slow
def test_dates(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    rows = df.orderBy("i").select(dates.partial_date(F.col("t")).alias("d")).collect()
    assert [tuple(r["d"]) if r["d"] else None for r in rows] == [spec(v) for v in values]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("2020-05-07", (2020, 5, 7)),
        ("12/05/2020", (2020, None, 20)),
        ("2020-13-01", (2020, None, 1)),
        ("2020-+5-07", (2020, 5, 7)),
        ("été 2001-05", (2001, None, 1)),
        ("12345", (1234, None, None)),
        ("0012 2020", None),
        ("", None),
        ("n.d.", None),
        ("　 1999 ", (1999, None, None)),
    ],
)
def test_date_cases(spark, value, expected):
    d = spark.createDataFrame([(value,)], "t string").select(dates.partial_date(F.col("t")).alias("d")).first()["d"]
    assert (tuple(d) if d else None) == expected


@pytest.mark.parametrize(
    ("path", "pdf", "stem", "json"),
    [
        ("/in/a.pdf", True, "a", "o/a.json"),
        ("/in/a.PdF", True, "a", "o/a.json"),
        ("/in/.pdf", False, ".pdf", "o/.pdf.json"),
        ("/in/a.b.pdf", True, "a.b", "o/a.b.json"),
        ("a", False, "a", "o/a.json"),
        ("/in.pdf/a", False, "a", "o/a.json"),
        ("/x/a.tei.xml", False, "a.tei", "o/a.tei.json"),
        ("/x/", False, "", "o/paper.tei.json"),
    ],
)
def test_paths(spark, path, pdf, stem, json):
    c = F.col("p")
    r = spark.createDataFrame([(path,)], "p string").select(paths.is_pdf(c).alias("pdf"), paths.file_stem(c).alias("stem"), paths.json_path("o/", c).alias("json")).first()
    assert (r["pdf"], r["stem"], r["json"]) == (pdf, stem, json)


def test_unicode_names_are_real():
    assert all(unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc") for c in SPACES)
