"""Text functions as Column expressions: cleaning, normalising, counting. NFC and the form of exact duplicates need Python (Arrow UDFs)."""

from __future__ import annotations

import unicodedata
from hashlib import md5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that become several others.
EXPANDED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "æ": "ae", "œ": "oe", "…": "...", "⋯": "..."}
#: Quotes, dashes and spaces that become plain ones.
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’‚‛‹›", "“”„‟«»"
DASHES = "–—―−﹘﹣－"
SPACES = "   　    "
PLAIN = (SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + SPACES, "'" * 6 + '"' * 6 + "-" * 7 + " " * 8)

#: Fixed value: the space separators of Unicode, which trimming takes off.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

#: What ends a line for splitting text into lines of any system.
LINE_END = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]"

#: What counts as an address in a text.
URL = r"(?iU)https?://[^\s<>\"']+"
EMAIL = r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def per_line(c: Column, each) -> Column:
    """each(line) for every line; an array."""
    return F.transform(F.split(c, "\n", -1), each)


def clean_invisible(c: Column) -> Column:
    """Format, control, private and surrogate characters go, but for line feed and tab."""
    return F.regexp_replace(c, r"[\p{Cf}\p{Cc}\p{Co}\p{Cs}&&[^\n\t]]", "")


def clean_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n|[\r\x0b\f]", "\n")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def clean_urls(c: Column, token: str = "") -> Column:
    return F.regexp_replace(c, URL, token)


def clean_emails(c: Column, token: str = "") -> Column:
    return F.regexp_replace(c, EMAIL, token)


def clean_repeats(c: Column) -> Column:
    """Five or more of one character become three."""
    return F.regexp_replace(c, r"(?d)(.)\1{4,}", "$1$1$1")


def clean_spaces(c: Column) -> Column:
    return F.array_join(per_line(c, lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}", " "), r"(?U)\s+\z", "")), "\n")


def clean_lines(c: Column, min_length: int = 10) -> Column:
    """Short lines and those of signs or digits go; blank lines stay, empty."""
    lines = per_line(c, lambda x: F.when(strip(x) == "", F.lit("")).otherwise(x))
    keep = lambda x: (x == "") | ((F.length(strip(x)) >= min_length) & ~strip(x).rlike(r"^[^a-zA-Z]{10,}\z") & ~strip(x).rlike(r"(?U)^\s*[\d\s.,\-+/:]{20,}\s*\z"))
    return F.array_join(F.filter(lines, keep), "\n")


def clean_blank(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def clean(c: Column, url_token: str = "", email_token: str = "", min_length: int = 10) -> Column:
    c = nfc(clean_newlines(clean_invisible(c)))
    c = clean_spaces(clean_repeats(clean_emails(clean_urls(c, url_token), email_token)))
    return strip(clean_blank(clean_lines(c, min_length)))


def normalise(c: Column, lower: bool = False) -> Column:
    """Typographic characters become plain ones; every line and the whole lose their outer white space."""
    for old, new in EXPANDED.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.translate(c, *PLAIN)
    c = F.lower(c) if lower else c
    lines = F.split(c, LINE_END, -1)
    return strip(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+\z", "")), "\n"))


def sentences(c: Column, shortest: int = 10, longest: int = 5000) -> Column:
    """Normalised sentences of at least shortest characters, cut to longest."""
    parts = F.split(normalise(c), r"(?U)(?<=[.!?])\s+(?=[A-Z])", -1)
    parts = F.transform(parts, lambda x: strip(F.regexp_replace(x, r"^(?U)[\s\-_=+*#@|\\]+", "")))
    return F.transform(F.filter(parts, lambda x: F.length(x) >= shortest), lambda x: F.substring(x, 1, longest))


def alpha_ratio(c: Column) -> Column:
    """Letters over characters that are no white space; 0 without any."""
    solid = F.length(F.regexp_replace(c, r"(?U)\s", ""))
    return F.when(solid > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / solid).otherwise(0.0)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+", -1), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def blank(c: Column) -> Column:
    """Whether nothing is left of a text by trimming."""
    return ~c.rlike(f"[^{BLANKS}]")


def formed(t: str) -> str:
    """What exact duplicates share: NFC, lower case, single spaces. As the SQL has it: letters change one by one, whatever
    follows them, and runs of ASCII white space (without vertical tabs) become a space; spaces of any width go at the ends."""
    if not t.isascii():
        t = unicodedata.normalize("NFC", t).replace("İ", "i").replace("Σ", "σ")
    t = t.lower()
    for c in "\t\n\f\r":
        t = t.replace(c, " ")
    while "  " in t:
        t = t.replace("  ", " ")
    return t.strip(BLANKS)


@F.pandas_udf(T.StringType())
def hash_form(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else formed(t))


@F.pandas_udf(T.StringType())
def content_hash(s: pd.Series) -> pd.Series:
    """MD5 of the form."""
    return s.map(lambda t: None if t is None else md5(formed(t).encode()).hexdigest())


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def characters(c: Column) -> Column:
    return F.filter(F.split(c, "", -1), lambda x: x != "")


def shingles(c: Column, n: int = 5) -> Column:
    """Distinct runs of n characters; none in shorter texts."""
    runs = lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - (n - 1)), lambda i: F.array_join(F.slice(s, i, n), ""))
    return bound(characters(c), lambda s: F.when(F.size(s) >= n, F.array_distinct(runs(s))).otherwise(F.array().cast("array<string>")))


def shingle_hash(c: Column) -> Column:
    """The first four bytes of MD5, as a little-endian number."""
    h = F.md5(c)
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")


def non_ascii(c: Column, sample: int = 200) -> Column:
    """Less than half of the first characters are ASCII."""
    head = F.substring(c, 1, sample)
    return (F.length(head) > 0) & (F.length(F.regexp_replace(head, r"[^\x00-\x7F]", "")) / F.length(head) < 0.5)


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def language_form(c: Column) -> Column:
    """Latin, CJK and Arabic letters in lower case, with single spaces between."""
    # No letter of these is white space, so all else becomes single spaces in one go.
    return F.trim(F.lower(F.regexp_replace(c, "[^a-zA-ZÀ-ÿ一-鿿؀-ۿ]+", " ")))


def slug(c: Column, longest: int = 63) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, longest)


def wiki_plain(c: Column) -> Column:
    """MediaWiki markup: templates, files and categories, piped links, headings, bold."""
    for pattern, new in ((r"\{\{[^}]*\}\}", ""), (r"\[\[(?:File|Category|Image):[^\]]*\]\]", ""), (r"\[\[[^|\]]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"), (r"={2,}([^=]+)={2,}", "$1"), (r"'{2,3}", "")):
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
