import pytest
from pyspark.sql import functions as F

from quern.functions import html, text, web
from quern.functions.calculator import calculate


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_invisible_characters_fuse_lines(spark):
    assert one(spark, "a\rb\x0bc​d\te\n", text.clean_invisible) == "abcd\te\n"


def test_newlines_alone(spark):
    assert one(spark, "a\r\nb\rc\x0bd\fe", text.clean_newlines) == "a\nb\nc\nd\ne"


def test_five_of_a_kind_become_three(spark):
    assert one(spark, "Whaaaaat!!!! no\n\n\n\n\n", text.clean_repeats) == "Whaaat!!!! no\n\n\n\n\n"


def test_short_sign_and_digit_lines_go_blank_lines_stay(spark):
    t = "Title\n\na line that is long enough\n--------------------\n12345 67890 12345 67890\n \nx"
    assert one(spark, t, text.clean_lines) == "\na line that is long enough\n"


def test_addresses(spark):
    assert one(spark, "see HTTPS://a.b/c?d or me@x.org now", lambda c: text.clean_emails(text.clean_urls(c))) == "see  or  now"


def test_nfc(spark):
    assert one(spark, "é", text.nfc) == "é"


def test_typography(spark):
    assert one(spark, "“ﬁne” – it’s… æ x  \n y ", text.normalise) == '"fine" - it\'s... ae x\n y'


def test_sentences(spark):
    assert one(spark, "First sentence here. Second one is here! no", text.sentences) == ["First sentence here.", "Second one is here! no"]


def test_counts(spark):
    assert one(spark, "  a b\n\tc ", text.word_count) == 3
    assert one(spark, "", text.word_count) == 0
    assert one(spark, "ab1 2", text.alpha_ratio) == 0.5
    assert one(spark, " ", text.alpha_ratio) == 0.0


def test_shingle_hash_is_little_endian_md5(spark):
    import hashlib
    import struct

    assert one(spark, "abcde", text.shingle_hash) == struct.unpack("<I", hashlib.md5(b"abcde").digest()[:4])[0]


def test_urls(spark):
    assert one(spark, "http://a.b:80/x#y", web.normalise_url) == "http://a.b/x"
    assert one(spark, "ftp://a.b", web.normalise_url) is None
    assert one(spark, "https://a.b:8443/x", web.domain) == "a.b:8443"


def test_robots_longest_match_and_ties(spark):
    rules = spark.createDataFrame([("*", "disallow", "/"), ("bot", "disallow", "/a"), ("bot", "allow", "/a/b"), ("bot", "allow", "/a"), ("bot", "disallow", "/*.pdf$")], "agent string, directive string, rule string")
    paths = spark.createDataFrame([("/a/b/c",), ("/a/x",), ("/z.pdf",), ("/z.pdfx",), ("/other",)], "path string")
    got = {r["path"]: r["allowed"] for r in web.robots_allowed(paths, rules, "bot").collect()}
    assert got == {"/a/b/c": True, "/a/x": True, "/z.pdf": False, "/z.pdfx": True, "/other": True}


def test_robots_files(spark):
    lines = ["User-agent: a", "User-agent: b", "Disallow: /x # no", "", "User-agent: *", "Allow: /"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "site string, number int, line string")
    assert {(r["agent"], r["directive"], r["rule"]) for r in web.robots_rules(df).collect()} == {("a", "disallow", "/x"), ("b", "disallow", "/x"), ("*", "allow", "/")}


PAGE = """<!DOCTYPE html><html lang="en-US-x"><head><title> A title </title><meta name="description" content="About it"><link rel="canonical" href="https://a.b/c"></head>
<body><nav><p>Navigation that is quite long, longer than thirty characters</p></nav><!-- a comment -->
<div class="sidebar"><p>Noise by its class name, also longer than thirty characters</p></div>
<article><h1>Short</h1><p>First paragraph that is long enough &amp;amp; fine<p>Second paragraph, which the first one ends implicitly
<ul><li><p>A nested paragraph is emitted twice, for item and itself</p></li></ul><script>var x = "no text from here at all";</script></article></body></html>"""


def test_extraction():
    parts = html.extract_text(PAGE).split("\n\n")
    assert parts[0] == "A title"
    assert parts[1:3] == ["First paragraph that is long enough & fine", "Second paragraph, which the first one ends implicitly"]
    assert parts[3] == parts[4] == "A nested paragraph is emitted twice, for item and itself"
    assert len(parts) == 5
    assert html.extract_text("") == html.extract_text("<p>short</p>") == ""


def test_metadata():
    assert html.page_metadata(PAGE) == {"title": "A title", "description": "About it", "language": "en-US", "canonical_url": "https://a.b/c"}


def test_links():
    assert html.links('<a href="/x">1</a><a href="#y">2</a><a href="mailto:z">3</a><a href="/x">4</a><a href="http://o/">5</a>', "https://a.b/c") == ["https://a.b/x", "http://o/"]


def test_calculator(spark):
    assert spark.range(1).select(calculate("sqrt(16) + 2 ** 3 - max(1, pi) * 0").alias("x")).first()["x"] == 12.0
    for bad in ("__import__('os')", "2 ** 5000", "x.y"):
        with pytest.raises(ValueError):
            calculate(bad)
