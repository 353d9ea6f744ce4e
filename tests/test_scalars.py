from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from pagespark.functions import scalars as S

BASES = ["http://a/b/c/d;p?q=1#f", "https://h.example.com", "https://h.example.com/x/", "https://h.example.com/x//y/z",
         "http://h:8080?q", "file:///etc/x", "mailto:a@b", ""]
REFS = ["g", "./g", "g/", "/g", "//g/h", "?y", "g?y", "#s", "g#s", ";x", "g;x", "", ".", "./", "..", "../", "../g",
        "../..", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "./../g", "./g/.", "g/./h", "g/../h", "http:g",
        "https://o.org/p?q#r", "HTTP://O.org", "mailto:z@y", "javascript:void(0)", "a//b", "/a//b", "//", "http://x",
        "?", "x y", "é?ü#ß"]


def test_normalize_url_equals_urljoin(spark):
    cases = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(cases, "base string, ref string")
    got = df.select("base", "ref", S.normalize_url(F.col("ref"), F.col("base")).alias("u")).collect()
    wrong = [(g.base, g.ref, g.u, urljoin(g.base, g.ref)) for g in got if g.u != urljoin(g.base, g.ref)]
    assert not wrong, wrong


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("  a \n\t b c  ", "http://a/b:1"), (None, "ftp://x"), ("", "a/b"), ("x", None)], "t string, u string"
    )
    rows = df.select(
        S.clean_text(F.col("t")).alias("t"),
        S.is_url_valid(F.col("u")).alias("v"),
        S.ensure_scheme(F.col("u")).alias("e"),
        S.safe_filename(F.col("u")).alias("f"),
        S.safe_filename(F.col("u"), strict=True).alias("s"),
        S.escape_html(F.lit("a<b>&c")).alias("h"),
    ).collect()
    assert [r.t for r in rows] == ["a b c", "", "", "x"]
    assert [r.v for r in rows] == [True, True, False, False]
    odd = [" http://a", "http:///p", "http://[::1]/", "http://[::1/", "1http://a", "a+b.c://d", "//a", "", "http://a b"]
    got = [r.v for r in spark.createDataFrame([(u,) for u in odd], "u string").select(S.is_url_valid(F.col("u")).alias("v")).collect()]

    def valid(u):
        try:
            return bool(urlparse(u).scheme and urlparse(u).netloc)
        except ValueError:
            return False

    assert got == [valid(u) for u in odd]
    assert [r.e for r in rows] == ["http://a/b:1", "https://ftp://x", "https://a/b", None]
    assert (rows[0].f, rows[0].s) == ("a_b:1", "a_b_1")
    assert rows[0].h == "a&lt;b&gt;&amp;c"
